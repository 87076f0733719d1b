"""Spoken language: switches between languages, politeness, regions, what recognisers make up, pieces to speak."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

# Words that belong to one language.
TAGALOG = [
    "ang", "ng", "mga", "po", "opo", "ako", "ikaw", "kayo", "niyo", "siya", "tayo", "namin", "natin", "nila", "iyan", "iyon", "ito", "dito", "doon",
    "kung", "kasi", "dahil", "pero", "para", "wala", "meron", "mayroon", "hindi", "oo", "magkano", "kailan", "paano", "bakit", "sino", "ano", "saan",
    "bayad", "hulog", "buwan", "araw", "salamat", "sige", "naman", "lang", "din", "rin", "nga", "muna", "pala", "yung", "pwede",
]
INDONESIAN = [
    "yang", "dan", "di", "ke", "dari", "untuk", "dengan", "pada", "adalah", "saya", "aku", "kamu", "anda", "kita", "mereka", "ini", "itu", "sudah",
    "belum", "akan", "bisa", "tidak", "nggak", "iya", "ya", "kalau", "karena", "tapi", "juga", "lagi", "masih", "berapa", "kapan", "bagaimana",
    "gimana", "kenapa", "siapa", "dimana", "bulan", "hari", "bayar", "cicilan", "angsuran", "denda", "tenor", "jatuh", "tempo", "terima", "kasih",
]
ENGLISH = [
    "the", "is", "are", "and", "but", "for", "with", "that", "this", "have", "will", "would", "can", "please", "thank", "you", "your", "what", "when",
    "how", "why", "who", "where", "which", "there", "here", "about", "from",
]
ENGLISH_DOMAIN = [
    "premium", "policy", "monthly", "annual", "grace", "period", "coverage", "beneficiary", "rider", "lapse", "claim", "payment", "plan", "insurance",
    "due", "date", "branch", "bank", "online", "transfer", "balance", "agent", "approve", "approved", "reject", "process", "customer", "service",
]
LEAST_SHARE = 0.15
# Formal and informal address, by language.
ADDRESS = {
    "fil": (r"(?i)\b(po|opo|kayo|niyo|ninyo|inyo|inyong)\b", r"(?i)\b(ka|mo|ikaw|iyo|kita|mong|iyong)\b"),
    "id": (r"(?i)\b(bapak|ibu|anda|pak|bu|silakan|mohon)\b", r"(?i)\b(kamu|lo|lu|gue|gua|elo)\b"),
}
ENGLISH_DRIFT = r"(?i)\b(the|is|are|was|were|and|but|for|with|that|this|there|have|has|will|would|could|should|please|thank|you|your|we|our|they|them|from|about|because|however|therefore|regarding)\b"
TAGLISH_LOCAL = [
    "po", "opo", "ang", "ng", "sa", "na", "ay", "mga", "ito", "iyan", "iyon", "kayo", "niyo", "ninyo", "inyo", "ako", "namin", "natin", "kami",
    "tayo", "hindi", "oo", "wala", "meron", "mayroon", "pwede", "puwede", "kung", "para", "dahil", "kasi", "pero", "at", "o", "salamat", "magandang",
    "araw", "umaga", "hapon", "gabi", "maganda", "mabuti", "sige", "lang", "din", "rin", "naman", "nga", "ba", "pa", "nyo", "ninyong", "tayong",
    "bayad", "hulog", "bago", "matapos", "tulong", "makakatulong", "naiintindihan", "ipapaabot", "ingat", "oras", "tawag", "tawagan", "balik",
    "check", "sandali",
]
# What recognisers return for silence, and words that are no answer alone.
HALLUCINATIONS = [
    "thank you", "thanks", "thank you.", "thanks for watching", "thanks for watching!", "thank you for watching", "you", "bye", "bye.", ".", "...", ". . .",
    "[silence]", "[music]", "(music)", "[blank_audio]", "subtitles by the amara.org community", "amara.org", "please subscribe",
]
FRAGMENTS = [
    "and", "so", "the", "a", "i", "um", "uh", "er", "ah", "eh", "mm", "hmm", "but", "or", "of", "to", "is", "it", "well", "like", "at", "in", "on",
    "ng", "na", "ba", "yung", "eh...", "ang", "sa", "yang", "di", "ke",
]
LONGEST_PIECE, SHORTEST_PIECE = 220, 24
VOICE_PREFIX = {"en": "en-", "fil": "fil-PH-", "tl": "fil-PH-", "id": "id-ID-"}


def _words(text: Column, pattern: str = "[a-z']+") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def _listed(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _among(words: Column, listed: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: F.array_contains(_listed(listed), w)))


def code_switch(text: Column) -> Column:
    """struct(languages, switched, shares): the languages with a real share of the words that belong to one, by share;
    a finance term counts as English beside another language."""
    def of(w: Column) -> Column:
        counts = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("lang")) for i, (name, n) in enumerate(
            (("tagalog", _among(w, TAGALOG)), ("indonesian", _among(w, INDONESIAN)), ("english", _among(w, ENGLISH + ENGLISH_DOMAIN))))])
        return X.let(F.struct(counts.alias("c"), (_among(w, ENGLISH_DOMAIN) > 0).alias("term")), shares)

    def shares(s: Column) -> Column:
        total = F.aggregate(s["c"], F.lit(0), lambda a, x: a + x["n"])
        found = F.filter(s["c"], lambda x: x["n"] > 0)
        large = F.filter(found, lambda x: x["n"] >= LEAST_SHARE * total)
        other = F.exists(large, lambda x: x["lang"] != "english")
        there = F.filter(found, lambda x: (x["n"] >= LEAST_SHARE * total) | ((x["lang"] == "english") & s["term"] & other))
        names = F.transform(F.reverse(F.array_sort(there)), lambda x: x["lang"])
        return F.struct(names.alias("languages"), (F.size(names) > 1).alias("switched"), F.map_from_entries(F.transform(found, lambda x: F.struct(x["lang"], x["n"] / total))).alias("shares"))

    return X.let(_words(text), of)


def english_share(text: Column) -> Column:
    return X.let(_words(text), lambda w: F.when(F.size(w) > 0, 1 - _among(w, TAGLISH_LOCAL) / F.size(w)).otherwise(F.lit(0.0)))


def register(text: Column, language: str = "fil") -> Column:
    """struct(mixed, drift): whether a sentence mixes formal and informal address, and the English that shouldn't be there."""
    local = language in ("fil", "tl")
    formal, informal = ADDRESS["fil" if local else "id"]
    mixed = F.exists(X.sentences(text), lambda s: s.rlike(formal) & s.rlike(informal))
    if local:
        long = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) > 6
        drift = F.when((english_share(text) > 0.85) & long, F.array(F.lit("reply is essentially all English"))).otherwise(F.array().cast("array<string>"))
    else:
        drift = F.transform(F.regexp_extract_all(text, F.lit(ENGLISH_DRIFT), F.lit(1)), lambda w: F.lower(w))
    return F.struct(mixed.alias("mixed"), drift.alias("drift"))


def region(text: Column, variants: dict[str, list[str]]) -> Column:
    """The variety with the most markers, the first of equals; a marker counts as a word, or where the text begins."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    best, name = F.lit(0), F.lit("standard")
    for variety, markers in variants.items():
        n = F.lit(0)
        for m in markers:
            n = n + (F.contains(padded, F.lit(f" {m.lower()} ")) | F.startswith(padded, F.lit(f" {m.lower()}"))).cast("int")
        name, best = F.when(n > best, F.lit(variety)).otherwise(name), F.greatest(n, best)
    return name


def is_silence(text: Column) -> Column:
    """Whether a transcript is what a recogniser returns when it heard nothing."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"""^[¡!¿?"']+|[¡!¿?"']+$""", "")
    bare = F.trim(F.regexp_replace(t, r"[.,]+$", ""))
    return (t == "") | t.isin(*HALLUCINATIONS) | bare.isin(*FRAGMENTS) | ~t.rlike(r"[\p{L}\p{N}]")


def is_prompt_echo(text: Column, prompt: Column) -> Column:
    """Whether a short transcript holds nothing but words of the recogniser's hint, two real ones at least."""
    def of(w: Column) -> Column:
        real = F.filter(w, lambda x: ~F.array_contains(_listed(FRAGMENTS), x))
        return X.let(_words(prompt, "[a-z]+"), lambda p: (F.size(p) > 0) & (F.size(real) >= 2) & (F.size(w) <= 6) & F.forall(real, lambda x: F.array_contains(p, x)))

    return X.let(_words(text, "[a-z]+"), of)


def is_own_voice(heard: Column, spoken: Column, least: float = 0.8) -> Column:
    """Whether three to six heard words, each as often as it was heard, are mostly among those just spoken."""
    def of(s: Column) -> Column:
        shared = F.size(F.filter(s["h"], lambda x: F.array_contains(s["s"], x)))
        return F.size(s["h"]).between(3, 6) & (shared >= least * F.size(s["h"]))

    return X.let(F.struct(_words(heard).alias("h"), _words(spoken).alias("s")), of)


def pieces(text: Column) -> Column:
    """array<string> to synthesise one by one: sentences, long ones cut at their last comma in reach, stubs joined."""
    none = F.array().cast("array<string>")

    def cut(s: Column) -> Column:
        start = F.struct(none.alias("out"), s.alias("rest"))

        def step(a: Column, _: Column) -> Column:
            head = F.substring(a["rest"], 1, LONGEST_PIECE)
            at = F.when(F.length(a["rest"]) > LONGEST_PIECE, F.length(head) - F.instr(F.reverse(head), ",") + 1)
            ok = F.contains(head, F.lit(",")) & (at - 1 >= SHORTEST_PIECE)
            new = F.struct(F.concat(a["out"], F.array(F.trim(F.substring(a["rest"], F.lit(1), at)))).alias("out"), F.trim(F.substring(a["rest"], at + 1, F.length(a["rest"]))).alias("rest"))
            return F.when(F.coalesce(ok, F.lit(False)), new).otherwise(a)

        times = F.sequence(F.lit(0), F.floor(F.length(s) / SHORTEST_PIECE).cast("int"))
        return F.aggregate(times, start, step, lambda a: F.concat(a["out"], F.array(a["rest"])))

    def merge(a: Column, p: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        short = F.coalesce(F.length(last) < SHORTEST_PIECE, F.lit(False))
        return F.when(short, F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), p)))).otherwise(F.concat(a, F.array(p)))

    parts = F.filter(F.transform(X.sentences(X.for_speech(text)), lambda s: F.trim(s)), lambda s: s != "")
    return F.aggregate(F.flatten(F.transform(parts, cut)), none, merge)


def is_native(language: Column, voice: Column) -> Column:
    out = F.lit(False)
    for code, prefix in VOICE_PREFIX.items():
        out = F.when(language == code, F.startswith(voice, F.lit(prefix))).otherwise(out)
    return out
