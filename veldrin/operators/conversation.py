"""What callers say, as columns: ages, amounts, answers; turns in their conversation; what replies are based on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Spoken numbers, scales, and the patterns of answers.
WORD_NUMBERS = {"eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
SCALES = {"k": 1_000, "thousand": 1_000, "ribu": 1_000, "m": 1_000_000, "million": 1_000_000, "juta": 1_000_000}
YES = r"(?i)\b(yes|yeah|yep|sure|correct|that is right|thats right|opo|oo|iya|ya|betul)\b"
NO = r"(?i)\b(no|nope|not really|hindi|tidak|bukan|belum)\b"
AGE = r"(?i)\b(\d{1,3})\s*(?:years?\s*old|yo\b|[.!?]*\s*$)|\bi am\s+(\d{1,3})\b|\bage\s+(?:is\s+)?(\d{1,3})\b"
CORRECTION = r"(?i)\b(actually|sorry|i mean|i meant|no wait|correction|scratch that|my mistake|let me correct|that was wrong|hindi pala|maaf|salah)\b"
AFFIRMATION = r"(?i)\b(yes|yeah|yep|no|nope|ok|okay|sure|right|fine|alright|thanks|got it|opo|oo|sige|iya|ya|baik|oke|hindi|tidak)\b"
SLOT_ANSWER = r"(?i)^\s*(i am|i'm|im|about|around|roughly|its|it's|just)?\s*[\d\s,]*(years?\s*old|k|thousand|ribu|juta|pesos?|php|rp)?[\s.,!]*$"
REFUSALS = ("do not have that", "don't have that", "do not have this", "rather not guess", "wrong information", "cannot answer", "do not have any information", "no information on")
# Words that prove nothing when a reply shares them with a record.
COMMON = [
    "the", "and", "for", "you", "your", "that", "this", "with", "have", "has", "are", "was", "will", "would", "can", "could", "any", "all", "not",
    "but", "from", "there", "here", "what", "when", "how", "who", "which", "our", "may", "one", "two", "yes", "sure", "okay", "please", "thank",
    "thanks", "ang", "mga", "ako", "ninyo", "iyan", "ito", "kayo", "kung", "para", "yang", "dan", "untuk", "dengan", "pada", "adalah", "saya", "anda",
    "ini", "itu", "sudah", "akan", "bisa", "tidak", "kami", "juga", "atau",
]
# Words that don't tell one question from another.
FILLER = [
    "what", "is", "the", "a", "an", "do", "does", "you", "your", "i", "my", "me", "can", "could", "would", "please", "tell", "about", "for", "of",
    "to", "and", "how", "it", "that", "so", "or", "not", "then", "just", "still", "again", "any", "are", "was", "be", "have", "has", "on", "in", "at",
    "with",
]
CITATION_OVERLAP, MIN_QUESTION, ACKNOWLEDGEMENT, HISTORY = 2, 8, 22, 8


def _words(text: Column, pattern: str = "[a-z]+") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _between(value: Column, lo: int, hi: int) -> Column:
    return F.when((value >= lo) & (value <= hi), value)


def read_age(text: Column, expecting: bool = False) -> Column:
    """An age that the text states: in a form that says so, in words, alone; or, if one is expected, any fit number."""
    stated = [F.nullif(F.regexp_extract(text, AGE, g), F.lit("")) for g in (1, 2, 3)]
    formed = _between(F.coalesce(*stated).cast("int"), 10, 110)
    w, numbers = _words(text), _map(WORD_NUMBERS)

    def total(i: Column) -> Column:
        first, second = F.try_element_at(numbers, F.element_at(w, i)), F.try_element_at(numbers, F.coalesce(F.try_element_at(w, i + 1), F.lit("")))
        return F.when(first >= 18, _between(first + F.when(second < 10, second).otherwise(F.lit(0)), 18, 110))

    spoken = F.try_element_at(F.filter(F.transform(F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))), total), lambda n: n.isNotNull()), F.lit(1))
    alone = _between(F.nullif(F.regexp_extract(text, r"^\s*(\d{1,3})[.!?]*\s*$", 1), F.lit("")).cast("int"), 10, 110)
    out = [formed, spoken, alone]
    if expecting:
        bare = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{2,3})\b"), F.lit(1)), lambda n: _between(n.cast("int"), 16, 100))
        out.append(F.try_element_at(F.filter(bare, lambda n: n.isNotNull()), F.lit(1)))
    return F.coalesce(*out)


def read_yes_no(text: Column) -> Column:
    yes, no = text.rlike(YES), text.rlike(NO)
    return F.when(yes != no, yes)


def read_money(text: Column) -> Column:
    """An amount that the text states: with a scale, as 4 to 9 digits, or in words before a scale word."""
    plain = F.regexp_replace(text, r"[,.](?=\d{3}\b)", "")
    scaled = r"(?i)\b(\d{1,3}(?:\.\d+)?)\s*(k|thousand|ribu|m|million|juta)\b"
    scales, numbers = _map(SCALES), _map(WORD_NUMBERS)
    amount = F.nullif(F.regexp_extract(plain, scaled, 1), F.lit("")).cast("double") * F.try_element_at(scales, F.lower(F.regexp_extract(plain, scaled, 2)))
    digits = F.nullif(F.regexp_extract(plain, r"\b(\d{4,9})\b", 1), F.lit("")).cast("long")
    w = _words(plain)

    def before(i: Column) -> Column:
        """The number that up to four words before word i say."""
        prior = F.slice(w, F.greatest(F.lit(1), i - 4), F.least(F.lit(4), i - 1))
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("part"))

        def step(a: Column, x: Column) -> Column:
            n, part = F.try_element_at(numbers, x), a["part"]
            grown = F.when(n.isNotNull(), part + n).when(x == "hundred", F.greatest(part, F.lit(1)) * 100).otherwise(F.lit(0).cast("long"))
            return F.struct((a["sum"] + F.when(n.isNull() & (x != "hundred"), part).otherwise(F.lit(0))).alias("sum"), grown.alias("part"))

        return F.aggregate(prior, start, step, lambda a: a["sum"] + a["part"]) * F.coalesce(F.try_element_at(scales, F.element_at(w, i)), F.lit(0))

    spoken = F.aggregate(F.transform(F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))), lambda i: F.when(F.try_element_at(scales, F.element_at(w, i)).isNotNull() & (i > 1), before(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.coalesce(amount.cast("long"), digits, F.nullif(spoken, F.lit(0).cast("long")))


def is_correction(text: Column) -> Column:
    return text.rlike(CORRECTION)


def needs_knowledge(text: Column) -> Column:
    """Whether a turn should be answered from the records: all but short replies, affirmations and plain answers."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) < MIN_QUESTION, False).when(F.contains(t, F.lit("?")), True).when((F.length(t) <= ACKNOWLEDGEMENT) & t.rlike(AFFIRMATION), False).when(t.rlike(SLOT_ANSWER) & t.rlike(r"\d"), False).otherwise(True)


def is_refusal(agent: Column, grounded: Column, sought: Column) -> Column:
    said = F.lit(False)
    for p in REFUSALS:
        said = said | F.contains(F.lower(agent), F.lit(p))
    return ~grounded & sought & said


def stems(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in FILLER])

    def stem(w: Column) -> Column:
        out = w
        for end in ("s", "es", "ed", "ing"):  # the first of ing, ed, es, s that leaves four letters is cut
            out = F.when(F.endswith(w, F.lit(end)) & (F.length(w) - len(end) >= 4), F.substring(w, F.lit(1), F.length(w) - len(end))).otherwise(out)
        return out

    return F.array_distinct(F.transform(F.filter(_words(text), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)), stem))


def same_question(a: Column, b: Column) -> Column:
    x, y = stems(a), stems(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y))) >= 0.5)


def escalation(text: Column, detect: dict[str, list[str]]) -> Column:
    """The first trigger of which a phrase occurs; empty if none does."""
    out = F.lit("")
    for trigger, listed in reversed(detect.items()):
        hit = F.lit(False)
        for p in listed:
            hit = hit | F.contains(F.lower(text), F.lit(p))
        out = F.when(hit, F.lit(trigger)).otherwise(out)
    return out


def distinctive(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in COMMON])
    return F.array_except(_words(text, "[a-z][a-z'-]{3,}"), stop)


def records_behind(reply: Column, records: Column) -> Column:
    """Of records (array of structs with title and content), those that share two distinctive words with the reply;
    with three records or more, words that more than half of them have don't count."""
    def own(spoken: Column) -> Column:
        return F.transform(records, lambda r: F.struct(r.alias("r"), F.array_intersect(spoken, distinctive(F.concat_ws(" ", r["content"], r["title"]))).alias("w")))

    def topical(o: Column) -> Column:
        words = F.array_distinct(F.flatten(F.transform(o, lambda x: x["w"])))
        common = F.filter(words, lambda w: F.size(F.filter(o, lambda x: F.array_contains(x["w"], w))) > F.size(o) / 2)
        return F.when(F.size(o) >= 3, common).otherwise(F.array().cast("array<string>"))

    def kept(o: Column) -> Column:
        return X.let(topical(o), lambda t: F.transform(F.filter(o, lambda x: F.size(F.array_except(x["w"], t)) >= CITATION_OVERLAP), lambda x: x["r"]))

    return X.let(distinctive(reply), lambda spoken: X.let(own(spoken), kept))


def exchanges(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, caller, agent, previous_agent): each user turn with the next assistant turn, and the last before."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumns({
        "_next_role": F.lead("role").over(order), "_next": F.lead("text").over(order),
        "previous_agent": F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("caller"), F.when(F.col("_next_role") == "assistant", F.col("_next")).otherwise(F.lit("")).alias("agent"), "previous_agent")


def history(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """turns with `history`, the texts of the n turns before."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list("text").over(order))


def sticky_region(turns: DataFrame, region: str = "region") -> DataFrame:
    """turns with `region_so_far`: the last region heard that isn't standard; standard until there is one."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("region_so_far", F.coalesce(F.last(F.nullif(F.col(region), F.lit("standard")), ignorenulls=True).over(order), F.lit("standard")))


def slot_evolution(answers: DataFrame) -> DataFrame:
    """From (conv_id, turn, slot, value, correcting): answers that count, with the value before and a log line for
    changes. The first answer to a slot is kept until a correcting turn gives another."""
    order = Window.partitionBy("conv_id", "slot").orderBy("turn")
    first = F.row_number().over(order) == 1
    rows = answers.where("value is not null").withColumn("_first", first).where("_first or correcting")
    rows = rows.withColumn("old", F.lag("value").over(order)).where("old is null or old <> value")
    return rows.select("conv_id", "turn", "slot", "value", F.when(F.col("old").isNotNull(), F.concat("slot", F.lit(": "), "old", F.lit(" -> "), "value")).alias("correction"))


def asked_counts(turns: DataFrame, slot: str = "asked_slot", most: int = 2) -> DataFrame:
    """turns with asked (times that the slot has been asked so far) and given_up."""
    order = Window.partitionBy("conv_id", slot).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("asked", F.count(slot).over(order)).withColumn("given_up", F.col("asked") >= most)


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): `role: text` lines in order."""
    lines = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return lines.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("transcript"))


def citations(turns: DataFrame) -> DataFrame:
    """(conv_id, citations, unanswered) of turns with citations, caller and refused: each citation once, as first given."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "citations", "caller", "refused"))).alias("t"))
    return rows.select("conv_id", F.array_distinct(F.flatten(F.transform("t", lambda x: x["citations"]))).alias("citations"), F.transform(F.filter("t", lambda x: x["refused"]), lambda x: x["caller"]).alias("unanswered"))
