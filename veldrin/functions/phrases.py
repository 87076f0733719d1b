"""The phrases of conversation signals, and the rules of nudges, each stated as it must be."""

# What a caller says, by kind and language, in the order in which kinds are reported.
CALLER = {
    "hardship": {
        "en": ["cannot afford", "can't afford", "too expensive", "lost my job", "out of work", "short of money", "tight this month", "no money", "struggling"],
        "fil": ["wala akong pera", "wala po akong pera", "mahal masyado", "medyo mahal", "hindi ko kaya", "walang trabaho", "nawalan ng trabaho", "kapos", "sakto lang"],
        "id": ["lagi susah", "belum ada uang", "tidak ada uang", "kena phk", "di-phk", "belum gajian", "berat", "kesulitan", "nggak ada uang"],
    },
    "payment_promise": {
        "en": ["i will pay", "i'll pay", "pay next week", "pay on friday", "after payday", "transfer tomorrow", "pay tomorrow"],
        "fil": ["magbabayad po ako", "babayaran ko po", "sa sweldo", "sa susunod na linggo po", "bukas po magbabayad"],
        "id": ["saya bayar", "nanti saya transfer", "setelah gajian", "minggu depan bayar", "besok saya bayar", "akan saya lunasi"],
    },
    "soft_refusal": {
        "en": ["i'll think about it", "let me think", "maybe later", "not right now", "call me back", "some other time"],
        "fil": ["titingnan ko po", "sa susunod na lang po", "mamaya na lang", "hindi muna po", "next time na lang po", "nanti"],
        "id": ["nanti aja", "belum sempat", "lain kali", "nanti dulu", "pikir-pikir dulu", "belum bisa sekarang"],
    },
    "hesitation": {
        "en": ["i don't know", "i dont know", "i am not sure", "i'm not sure", "not really sure", "maybe", "i guess", "possibly", "depends", "hard to say", "no idea"],
        "fil": ["hindi ko po alam", "ewan ko po", "siguro po", "baka po", "hindi po ako sigurado", "depende po"],
        "id": ["saya tidak tahu", "nggak tahu", "kurang tahu", "mungkin", "belum yakin", "tergantung", "kayaknya"],
    },
    "confusion": {
        "en": ["i don't understand", "what do you mean", "come again", "sorry what", "you lost me", "say that again"],
        "fil": ["hindi ko po maintindihan", "ano po yun", "paano po yun", "pakiulit po", "hindi ko gets"],
        "id": ["saya tidak mengerti", "maksudnya gimana", "kurang paham", "bisa diulangi", "gimana maksudnya"],
    },
    "frustration": {
        "en": ["this is ridiculous", "waste of my time", "i already told you", "i said already", "not listening", "fed up", "unacceptable"],
        "fil": ["sinabi ko na po", "paulit-ulit", "nakakainis", "ang tagal naman", "hindi niyo po ako pinapakinggan"],
        "id": ["sudah saya bilang", "berulang-ulang", "buang waktu", "capek deh", "nggak didengerin"],
    },
    "buying_signal": {
        "en": ["how do i sign up", "how much is it", "what do i need", "sounds good", "let's do it", "send me the details"],
        "fil": ["paano po mag-apply", "magkano po", "ano pong kailangan", "sige po, tuloy natin", "pakisend po"],
        "id": ["gimana caranya", "berapa biayanya", "apa syaratnya", "boleh dikirim detailnya", "saya tertarik"],
    },
}
# Mentions worth an offer.
OPPORTUNITY = {
    "second_vehicle": {
        "en": ["another car", "second car", "another vehicle", "second vehicle", "my other car", "we have two cars", "also have a motorbike"],
        "fil": ["may isa pa po kaming sasakyan", "dalawa po ang sasakyan namin", "may motor din po ako"],
        "id": ["mobil satunya", "ada mobil lagi", "punya dua mobil", "motor saya juga", "kendaraan satu lagi"],
    },
    "family_member": {
        "en": ["my wife", "my husband", "my spouse", "my son", "my daughter", "my kids", "my children", "for my parents", "my mother", "my father"],
        "fil": ["asawa ko po", "anak ko po", "mga anak ko po", "misis ko po", "nanay ko po", "tatay ko po"],
        "id": ["istri saya", "suami saya", "anak saya", "orang tua saya", "ibu saya", "bapak saya"],
    },
    "existing_cover": {
        "en": ["i already have a policy", "i have insurance with", "covered through work", "my company covers", "another provider"],
        "fil": ["may insurance na po ako", "may policy na po ako", "sa company po may coverage"],
        "id": ["sudah punya asuransi", "ada asuransi dari kantor", "di perusahaan lain"],
    },
}
# Words by which an agent's reply takes up a mention.
FOLLOWED_UP = [
    "add", "include", "cover", "also", "too", "second", "additional", "extra", "as well", "them", "family", "dependant", "dependent", "spouse", "driver",
    "kasama", "isama", "din po", "dagdag", "tambah", "sekalian", "juga", "tambahan", "keluarga",
]
# What an agent must not say.
AGENT_RISK = {
    "guarantee": ["guaranteed", "i guarantee", "definitely approved", "sigurado po", "garantisado", "pasti disetujui", "dijamin", "siguradong maaprubahan"],
    "pressure": ["last chance", "today only", "you must decide now", "ngayon lang po", "huling pagkakataon", "harus sekarang", "kalau tidak sekarang"],
    "threat": ["we will take the vehicle", "kukunin ang sasakyan", "mobilnya kami tarik", "akan kami tarik", "penarikan unit"],
}
# Decisions, and what makes them preliminary.
DECISION = ["you are eligible", "you qualify", "you're approved", "you are approved", "approved", "qualified", "kwalipikado", "aprubado", "anda memenuhi syarat", "disetujui", "layak"]
QUALIFIER = [
    "subject to", "pending", "preliminary", "initial", "indicative", "final approval", "underwriting", "still needs", "once we", "after we", "depends on", "provisional",
    "depende", "kailangan pa", "pansamantala", "paunang", "tergantung", "sementara", "masih perlu", "awal", "belum final",
]
# Words that don't tell questions apart.
STOPWORDS = ["the", "a", "an", "is", "are", "do", "does", "po", "ang", "ng", "ba", "sa", "ko", "yang", "di", "ke", "saya", "apa", "what", "how", "and", "or", "to", "of", "in", "on", "for", "my", "i"]
# Kinds after which a model is asked.
DELIBERATE = ["frustration", "soft_refusal", "hardship", "repeated_question"]

# Nudge rules: priority, least confidence, cooldown in turns, audience, advice.
NUDGES = {
    "agent_guarantee": (100, 0.85, 0, "supervisor", "The agent promised an outcome it cannot promise. Correct it on this call before the customer relies on it."),
    "agent_threat": (100, 0.85, 0, "supervisor", "Repossession was raised. Stop that line and return to the payment date."),
    "agent_pressure": (95, 0.85, 2, "supervisor", "That is pressure selling. Drop the deadline and let them decide."),
    "missing_disclosure": (92, 0.8, 2, "supervisor", "That was said as a decision. Add that it is preliminary and subject to underwriting, on this call."),
    "escalation": (90, 0.9, 0, "supervisor", "Handing to a person now. Pick up with what has already been collected rather than starting again."),
    "hardship": (80, 0.7, 4, "supervisor", "Genuine difficulty, not an objection. Stop asking for payment and offer the restructuring options."),
    "frustration": (75, 0.75, 3, "supervisor", "The caller is losing patience. Acknowledge it directly and stop asking questions for a turn."),
    "churn_risk": (74, 0.75, 4, "supervisor", "This call is about to end badly. Offer a person or a callback now."),
    "soft_refusal": (70, 0.72, 3, "agent", "That was a no, not a maybe. Stop selling and agree a callback."),
    "repeated_question": (65, 0.75, 2, "agent", "Asked before and not answered. Say plainly that it cannot be answered here rather than answering around it again."),
    "knowledge_gap": (40, 0.9, 1, "supervisor", "Nothing in the knowledge base covered this. Worth adding."),
    "data_conflict": (60, 0.9, 0, "supervisor", "The caller changed an earlier answer. Confirm which one is right before it reaches the lead."),
    "missed_opportunity": (58, 0.72, 5, "agent", "They mentioned something worth covering and it went past. Offer it before moving on."),
    "buying_signal": (55, 0.72, 3, "supervisor", "They are ready. Move to the next step rather than continuing to qualify."),
    "payment_promise": (50, 0.72, 3, "supervisor", "A date was given. Confirm it back and record it."),
    "hesitation": (52, 0.72, 3, "agent", "The caller is undecided rather than refusing. Ask what would help them decide instead of moving to the next question."),
    "confusion": (45, 0.72, 2, "agent", "The last answer did not land. Say it again in shorter sentences."),
    "dead_air": (35, 0.9, 2, "supervisor", "Long silence. Check the caller is still there."),
}
CONTEXT_ONLY = ("sentiment", "intent")
