"""Vocabularies, patterns and weights that results depend on, each stated as it must be."""

# Authority ranks, weights and defaults.
AUTHORITY_RANK = {"binding": 1, "operational": 2, "published": 3, "promotional": 4}
UNKNOWN_RANK = 9
AUTHORITY_WEIGHT = {"binding": 1.00, "operational": 0.92, "published": 0.78, "promotional": 0.35}
UNKNOWN_WEIGHT = 0.78
AUTHORITY_BY_TYPE = {"pdf_policy": "binding", "pdf_table": "binding", "rules_file": "operational", "form_export": "operational", "web_page": "published"}

# Units, by a marker in the reference and by what the origin contains, in order.
UNITS = ("health_ph_en", "life_ph", "multifinance_id")
UNIT_IN_REF = r"#(health_ph_en|life_ph|multifinance_id)\b"
UNIT_BY_ORIGIN = (
    ("health-shield", "health_ph_en"), ("health_shield", "health_ph_en"), ("life-philippines", "life_ph"),
    ("multifinance", "multifinance_id"), ("partners", "group"), ("lead_form", "group"),
)

# Category patterns, the first that matches wins, letter case ignored.
CATEGORIES = (
    ("corporate", r"^about solara|^tentang solara|^contact|office hours"),
    ("objection", r"common concerns|too expensive|already covered|rather think about it|wasted money|medyo mabigat|keberatan"),
    ("partnership_benefits", r"partner|commission|accredited agent|bancassurance partnership"),
    ("qualification", r"who can apply|eligib|entry age|criteria that|syarat|dokumen yang|required fields|form fields|values accepted"),
    ("policy_rule", r"waiting period|not covered|exclusion|lapse|grace period|reinstat|cancel|denda|keterlambatan|penagihan|prohibited|escalation|must never|restrukturisasi|beneficiar"),
    ("pricing", r"premium|rate table|monthly premium|loading|down payment|commission structure|cicilan|angsuran|biaya|tarif|available terms"),
    ("process", r"how to apply|how do i|claim|paying your|pembayaran|pelunasan|kewajiban pembayaran|training and support|becoming an"),
    ("faq", r"frequently asked|common questions|pertanyaan|\?$"),
    ("product", r"plan|cover|rider|produk|pembiayaan|term life|whole life|educational|shield|compare"),
    ("corporate", r"about solara|tentang solara|contact|office"),
)
DEFAULT_CATEGORY = "product"

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

# Concepts and their spellings.
TERMINOLOGY = {
    "premium": ("contribution", "monthly due", "bayad", "hulog", "premium payment"),
    "installment": ("cicilan", "angsuran", "setoran", "monthly payment"),
    "waiting_period": ("waiting period", "qualifying period", "elimination period"),
    "lapse": ("lapse", "nahinto", "terminated for non-payment"),
    "due_date": ("due date", "jatuh tempo", "takdang araw"),
    "late_fee": ("denda", "late fee", "penalty", "surcharge"),
    "down_payment": ("down payment", "uang muka", " dp "),
    "tenor": ("tenor", "jangka waktu", "loan period"),
    "beneficiary": ("beneficiary", "benepisyaryo", "nominee"),
    "rider": ("rider", "add-on", "supplementary benefit"),
    "pre_existing_condition": ("pre-existing condition", "pre-existing", "prior illness"),
    "grace_period": ("grace period",),
    "sum_assured": ("sum assured", "coverage amount"),
}

# Durations and the topics that they belong to.
WORD_NUMBERS = {"two": 2, "three": 3, "ten": 10, "twelve": 12, "twenty-four": 24, "thirty": 30, "sixty": 60, "ninety": 90}
DURATION = r"(?i)(\d+|thirty|sixty|ninety|twenty-four|twelve|ten|two|three)\s*[\(\)0-9\s]*(day|month|year)s?"
UNIT_DAYS = {"day": 1, "month": 30, "year": 365}
TOPICS = {
    "pre_existing_waiting": r"(?i)pre-existing|condition that existed before|existing sickness|prior illness",
    "grace_period": r"(?i)grace period",
    "illness_waiting": r"(?i)illness(es)? (are|is) covered|applies to all illness",
}

# Personal data, in the order in which kinds claim their spans.
LOCALITY_TAIL = r"(?:,\s*[A-Z][\w.'-]*(?:\s+[A-Z][\w.'-]*){0,3}){0,3}"
PII = (
    ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b"),
    ("GOV_ID_PH", r"(?i)\bTIN[\s:]*\d{3}-\d{3}-\d{3}\b"),
    ("GOV_ID_ID", r"\bKTP[\s:]*\d{16}\b|\b\d{16}\b"),
    ("GOV_ID_ID_NPWP", r"(?i)\bNPWP[\s:]*[\d.\-]{15,20}\b"),
    ("PHONE_PH", r"(?:\+63[\s-]?|\b0)9\d{2}[\s-]?\d{3}[\s-]?\d{4}\b"),
    ("PHONE_ID", r"\+62[\s-]?8\d{2}[\s-]?\d{4}[\s-]?\d{3,4}\b"),
    ("ACCOUNT", r"\b(?:HS|LP|MF)-\d{4}-\d{4,6}\b"),
    ("DOB", r"\b\d{1,2}/\d{1,2}/(?:19\d{2}|20[01]\d)\b"),
    ("ADDRESS", r"(?i)\b(?:\d+[A-Za-z]?\s+)?(?:Jl\.|Jalan|Block|Blk|Unit|Purok|Barangay|Brgy\.?)\s+[^,\n]{3,60}" + LOCALITY_TAIL),
    ("ADDRESS", r"\b\d{1,4}\s+[A-Z][A-Za-z'.-]+(?:\s+[A-Z][A-Za-z'.-]+){0,3}\s+(?:Street|St\.|Avenue|Ave\.?|Road|Rd\.?|Drive|Highway)\b" + LOCALITY_TAIL),
)
NAME = r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z']{1,}){1,3}\b"
NOT_A_NAME = [
    "solara", "finance", "group", "health", "shield", "life", "philippines", "multifinance", "indonesia", "insurance", "corporation", "assurance",
    "essential", "plus", "max", "term", "whole", "educational", "plan", "bank", "partner", "meridian", "tower", "bonifacio", "global", "city",
    "taguig", "jakarta", "selatan", "pusat", "bandung", "surabaya", "semarang", "jawa", "barat", "timur", "tengah", "quezon", "makati", "manila",
    "davao", "cavite", "pasig", "iloilo", "baguio", "cebu", "pampanga", "leyte", "yogyakarta", "sleman", "surakarta", "waiting", "period", "premium",
    "policy", "cover", "benefit", "claim", "rider", "maternity", "critical", "illness", "hospital", "accredited", "member", "annual", "monthly",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "monday", "saturday",
    "sunday", "pasal", "otoritas", "jasa", "keuangan", "menara", "lantai", "kartu", "keluarga", "toyota", "honda", "avanza", "vario", "brio",
    "singapore", "thailand", "malaysia", "asia", "east", "south", "philippine", "republic", "distribution", "operations", "lead", "product",
    "interest", "agent", "notes", "full", "name", "home", "address", "contact", "gov", "income", "account", "street", "avenue", "road", "drive",
    "pembiayaan", "mobil", "motor", "multiguna", "baru", "bekas", "slip", "gaji", "rekening", "koran", "terakhir", "usia", "tenor", "denda",
    "angsuran", "cicilan", "surat", "peringatan", "pertama", "kedua", "kunjungan", "lapangan",
]

# Ranking.
RRF_K = 60
SIMILARITY_FLOOR, SIMILARITY_WEIGHT, CONTRADICTION_PENALTY = 0.50, 0.05, 0.5
TOP_K, MIN_SCORE = 5, 0.35
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# Near duplicates, chunks, conflicts.
SIMILARITY_THRESHOLD = 0.72
MAX_CHUNK, OVERLAP, MIN_CHUNK = 1400, 180, 120
EQUIVALENCE_TOLERANCE = 0.10
