"""How well a recogniser heard: words said and heard, numbers written one way, what became of each word that was lost.

Numbers come as words or digits, whole or in parts, in three languages. A text's words are normalised by two folds over
its array: tens take the unit that follows, and a run of numerals with a scale word in it becomes the number that it
means; runs of digits without a scale, as an account number is read out, stay as they are. A word counts as heard if it
is among the words heard, or within them run together; one that isn't is told apart by what is left of it.

Null texts are empty ones. Without words said the accuracy is 0. Numerals of more than 15 digits are words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import speech

# Number words as recognisers write them; with teens and scales for texts that aren't folded.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90"}
TEENS_AND_SCALES = {
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "hundred": "100", "thousand": "1000"}
TENS = ["20", "30", "40", "50", "60", "70", "80", "90"]
# Indonesian and Filipino numerals, scales of the three languages, the Filipino linker at a word's end.
UNITS = {
    "satu": 1, "dua": 2, "tiga": 3, "empat": 4, "lima": 5, "enam": 6, "tujuh": 7, "delapan": 8, "sembilan": 9, "sepuluh": 10,
    "isa": 1, "dalawa": 2, "tatlo": 3, "apat": 4, "anim": 6, "pito": 7, "walo": 8, "siyam": 9, "sampu": 10}
SCALES = {
    "ratus": 100, "seratus": 100, "ribu": 1000, "seribu": 1000, "juta": 1_000_000, "sejuta": 1_000_000, "daan": 100, "raan": 100, "libo": 1000, "milyon": 1_000_000,
    "hundred": 100, "thousand": 1000, "million": 1_000_000}
LINKER = "ng"
# Words of regional speech, by accent.
REGIONAL = {
    "javanese": ["nuwun", "sewu", "kulo", "dereng", "saget", "mbayar", "niki", "nggih", "monggo", "sampun", "wingi", "sonten", "matur", "panjenengan", "mboten"],
    "sundanese": ["punten", "abdi", "teh", "can", "tiasa", "mayar", "ayeuna", "muhun", "bade", "payun", "hatur", "nuhun", "mangga", "sae"]}
SIMILAR, ANYWHERE_FROM = 0.6, 4
_STRINGS = "array<string>"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def merged_tens(words: Column) -> Column:
    """Each of TENS that one digit follows, with it added."""
    start = F.struct(F.array().cast(_STRINGS).alias("out"), F.lit(None).cast("string").alias("held"))

    def step(a: Column, w: Column) -> Column:
        joins = F.coalesce(a["held"].isin(TENS) & w.rlike("^[0-9]$"), F.lit(False))
        one = F.array((a["held"].cast("int") + F.try_to_number(w, F.lit("9")).cast("int")).cast("string"))
        kept = F.when(a["held"].isNull(), F.array().cast(_STRINGS)).otherwise(F.array(a["held"]))
        return F.struct(F.concat(a["out"], F.when(joins, one).otherwise(kept)).alias("out"), F.when(~joins, w).alias("held"))

    return F.aggregate(words, start, step, lambda a: F.array_compact(F.concat(a["out"], F.array(a["held"]))))


def folded(words: Column) -> Column:
    """Runs of two numerals or more, a scale among them, as the one number that they mean."""
    units, scales = _map(UNITS | {f"{w}{LINKER}": n for w, n in UNITS.items()}), _map(SCALES)
    zero, none = F.lit(0).cast("long"), F.array().cast(_STRINGS)
    start = F.struct(none.alias("out"), none.alias("run"), zero.alias("total"), zero.alias("current"), F.lit(False).alias("scaled"))

    def closed(a: Column) -> Column:
        whole = a["scaled"] & (F.size(a["run"]) >= 2)
        return F.concat(a["out"], F.when(whole, F.array((a["total"] + a["current"]).cast("string"))).otherwise(a["run"]))

    def step(a: Column, w: Column) -> Column:
        unit = F.coalesce(F.try_element_at(units, w).cast("long"), F.when(w.rlike("^[0-9]{1,15}$"), w.cast("long")))
        scale = F.try_element_at(scales, w).cast("long")
        grown = F.greatest(a["current"], F.lit(1)) * scale
        run = F.concat(a["run"], F.array(w))
        return F.when(unit.isNotNull(), F.struct(a["out"].alias("out"), run.alias("run"), a["total"].alias("total"), (a["current"] + unit).alias("current"), a["scaled"].alias("scaled"))).when(
            scale.isNotNull(), F.struct(a["out"].alias("out"), run.alias("run"), F.when(scale >= 1000, a["total"] + grown).otherwise(a["total"]).alias("total"), F.when(scale >= 1000, zero).otherwise(grown).alias("current"), F.lit(True).alias("scaled"))).otherwise(
            F.struct(F.concat(closed(a), F.array(w)).alias("out"), none.alias("run"), zero.alias("total"), zero.alias("current"), F.lit(False).alias("scaled")))

    return F.aggregate(words, start, step, closed)


def normalised(text: Column, fold: bool = True) -> Column:
    """array<string>, the words of a text with its numbers written one way. fold False: tens are merged, scales are words."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    if fold:
        plain = F.regexp_replace(F.regexp_replace(plain, r"(?U)\brp\.?\s*", ""), r"(\d)[.,](?=\d{3}(?!\d))", "$1")
    known = _map(NUMBER_WORDS if fold else NUMBER_WORDS | TEENS_AND_SCALES)
    words = merged_tens(F.transform(F.regexp_extract_all(plain, F.lit("[a-z0-9']+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at(known, w), w)))
    return folded(words) if fold else words


def missed(said: Column, heard: Column) -> Column:
    """Of normalised words said, in order, those that are neither among those heard nor within them run together."""
    return X.let(F.array_join(heard, ""), lambda whole: F.filter(said, lambda w: ~F.array_contains(heard, w) & ~F.contains(whole, w)))


def accuracy(said: Column, lost: Column) -> Column:
    return F.when(F.size(said) > 0, 1 - F.size(lost) / F.size(said)).otherwise(F.lit(0.0))


def similar(word: Column, heard: Column) -> Column:
    """The heard word that a lost one most likely turned into, the first of equals; empty if none is like it."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")

    def count(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))

    def ratio(other: Column) -> Column:
        longest = F.greatest(F.length(word), F.length(other))
        aligned = F.size(F.filter(F.transform(letters, lambda c, i: (c == F.substring(other, i + 1, F.lit(1))) & (i < F.length(other))), lambda same: same))
        anywhere = F.aggregate(F.transform(F.array_distinct(letters), lambda c: F.least(count(word, c), count(other, c))), F.lit(0), lambda a, n: a + n)
        best = F.when(F.length(word) >= ANYWHERE_FROM, F.greatest(aligned, anywhere)).otherwise(aligned)
        far = F.abs(F.length(other) - F.length(word)) > F.greatest(F.lit(3), F.floor(F.length(word) / 2))
        return F.when(far, F.lit(0.0)).otherwise(best / longest)

    start = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("ratio"))
    found = F.aggregate(F.transform(heard, lambda o: F.struct(o.alias("word"), ratio(o).alias("ratio"))), start, lambda a, x: F.when(x["ratio"] > a["ratio"], x).otherwise(a))
    return X.let(found, lambda f: F.when(f["ratio"] >= SIMILAR, f["word"]).otherwise(F.lit("")))


def failure(word: Column, heard: Column, accent: Column, dropped: Column) -> Column:
    """Why a word was lost. heard: normalised; dropped: whether one of two languages said didn't come through."""
    regional = F.lit(False)
    for name, listed in REGIONAL.items():
        regional = regional | ((F.coalesce(accent, F.lit("")) == name) & word.isin(listed))

    def of(near: Column) -> Column:
        return F.when(F.size(heard) == 0, F.lit("whole utterance lost")).when(regional & (near != ""), F.concat(F.lit("regional word, heard as "), near)).when(regional, F.lit("regional word, dropped")).when(
            dropped, F.lit("one language dropped")).when(word.rlike("[0-9]"), F.lit("number")).when(near != "", F.concat(F.lit("heard as "), near)).otherwise(F.lit("dropped"))

    return X.let(similar(word, heard), of)


def scored(results: DataFrame) -> DataFrame:
    """results (said, heard, accent and more) with accuracy, missed, and failures, an array of (word, failure)."""
    rows = results.withColumns({"_said": normalised(F.col("said")), "_heard": normalised(F.col("heard"))})
    switched = [speech.code_switch(F.coalesce(c, F.lit("")))["switched"] for c in ("said", "heard")]
    rows = rows.withColumns({"missed": missed(F.col("_said"), F.col("_heard")), "_dropped": switched[0] & ~switched[1]})
    failures = F.transform("missed", lambda w: F.struct(w.alias("word"), failure(w, F.col("_heard"), F.col("accent"), F.col("_dropped")).alias("failure")))
    return rows.withColumns({"accuracy": accuracy(F.col("_said"), F.col("missed")), "failures": failures}).drop("_said", "_heard", "_dropped")


def report(scores: DataFrame, *by: str) -> DataFrame:
    """By provider, market or the like, from scored rows with milliseconds: results, mean accuracy, median latency, and how
    many words were lost to each kind of failure; what a word was heard as doesn't count."""
    kind = F.regexp_replace("f.failure", " as .*$", "")
    lost = scores.select(*by, F.explode("failures").alias("f")).groupBy(*by, kind.alias("kind")).agg(F.count("*").alias("n"))
    kinds = lost.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("failures"))
    return scores.groupBy(*by).agg(F.count("*").alias("n"), F.avg("accuracy").alias("accuracy"), F.median("milliseconds").alias("median_ms")).join(kinds, list(by), "left")
