"""Text as Column expressions: tokens, hashes, shingles, sentences, dates, claims, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab



def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: what a lambda refers to is evaluated for each element otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


SENTENCE = r"(?<=[.!?])\s+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of the sha256 of the tokens; what isn't a-z or a digit doesn't count."""
    return F.substring(F.sha2(F.array_join(tokens(text), " "), 256), 1, 16)


def stable_id(source_ref: Column, chunk: Column) -> Column:
    return F.concat(F.lit("kb_"), F.substring(F.sha2(source_ref, 256), 1, 10), F.lit("_"), F.format_string("%02d", chunk))


def shingles(text: Column, size: int = 5) -> Column:
    """The distinct runs of `size` tokens; a shorter text is one run, a text without tokens none."""
    return let(tokens(text), lambda words: shingles_of(words, size))


def shingles_of(words: Column, size: int = 5) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    none = F.array().cast("array<string>")
    return F.when(F.size(words) >= size, F.array_distinct(runs)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(none)


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """The shingles of `shingles` as 64-bit hashes, each once: of the words themselves, without a string a shingle."""
    def of(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))
        return F.when(F.size(words) >= size, F.array_distinct(runs)).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    return let(tokens(text), of)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE)


def clean_text(text: Column) -> Column:
    """Without [n] citation marks, blanks collapsed, blank lines collapsed to one, ends trimmed."""
    out = F.regexp_replace(text, r"\[\d+\]", "")
    out = F.regexp_replace(out, "[ \\t\u00a0]+", " ")
    out = F.regexp_replace(out, r"\n\s*\n+", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def _rewrite(state: Column, pattern: str, groups: int, iso) -> Column:
    """struct(text, changed) with each match in state.text replaced by iso(groups...) unless that is null."""
    def each(st: Column) -> Column:
        text = st["text"]
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)])
        new = F.zip_with(parts, hits, lambda p, h: F.coalesce(iso(*[p[f"g{g}"] for g in range(1, groups + 1)]), h))
        gaps = F.split(text, pattern, -1)
        out = F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, n: F.concat(g, n)), "")
        changed = F.size(F.filter(F.zip_with(hits, new, lambda h, n: n != h), lambda x: x))
        return F.when(text.rlike(pattern), F.struct(out.alias("text"), (st["changed"] + changed).alias("changed"))).otherwise(st)

    return let(state, each)


def normalise_dates(text: Column) -> Column:
    """struct(text, changed): dd/mm/yyyy, Month d, yyyy and d Mon yy as ISO dates, in this order; nothing checks that
    the day exists."""
    def two(c: Column) -> Column:
        return F.lpad(c, 2, "0")

    months = F.create_map(*[F.lit(x) for i, m in enumerate(vocab.MONTHS, 1) for x in (m.lower(), f"{i:02d}")])
    short = F.create_map(*[F.lit(x) for i, m in enumerate(vocab.MONTHS, 1) for x in (m[:3].lower(), f"{i:02d}")])
    out = F.struct(text.alias("text"), F.lit(0).alias("changed"))
    out = _rewrite(out, r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", 3, lambda d, m, y: F.concat_ws("-", y, two(m), two(d)))
    out = _rewrite(out, r"\b([A-Z][a-z]+)\s+(\d{1,2}),?\s+(\d{4})\b", 3, lambda m, d, y: F.concat(y, F.lit("-"), F.try_element_at(months, F.lower(m)), F.lit("-"), two(d)))
    return _rewrite(out, r"\b(\d{1,2})\s+([A-Z][a-z]{2})\s+(\d{2})\b", 3, lambda d, m, y: F.concat(F.lit("20"), y, F.lit("-"), F.try_element_at(short, F.lower(m)), F.lit("-"), two(d)))


def terminology(text: Column) -> Column:
    """struct(concepts, variants): concepts of which a spelling occurs, and all their spellings, sorted."""
    return let(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), _terms)


def _terms(padded: Column) -> Column:
    table = F.array(*[F.struct(F.lit(c).alias("concept"), F.array(*[F.lit(s) for s in (c.replace("_", " "), *alt)]).alias("words")) for c, alt in vocab.TERMINOLOGY.items()])
    found = F.filter(table, lambda t: F.exists(t["words"], lambda w: F.contains(padded, w)))
    variants = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(found, lambda t: t["words"])), lambda w: F.trim(w))))
    return F.struct(F.transform(found, lambda t: t["concept"]).alias("concepts"), variants.alias("variants"))


def claimed_durations(text: Column, topic: str) -> Column:
    """array<struct<days, quote>> by days: durations in the sentences that the topic's pattern matches, each with the
    first sentence that states it."""
    about = F.filter(sentences(text), lambda s: s.rlike(topic))

    def of(s: Column) -> Column:
        values = F.regexp_extract_all(s, F.lit(vocab.DURATION), F.lit(1))
        units = F.regexp_extract_all(s, F.lit(vocab.DURATION), F.lit(2))
        return F.zip_with(values, units, lambda v, u: F.struct((_number(v) * _days(u)).alias("days"), F.trim(s).alias("quote")))

    none = F.array().cast("array<struct<days:bigint,quote:string>>")
    first = F.aggregate(F.flatten(F.transform(about, of)), none, lambda acc, c: F.when(F.exists(acc, lambda x: x["days"] == c["days"]) | c["days"].isNull(), acc).otherwise(F.concat(acc, F.array(c))))
    return F.array_sort(first)


def _number(v: Column) -> Column:
    out = F.expr("try_cast(null as bigint)")
    for word, n in vocab.WORD_NUMBERS.items():
        out = F.when(F.lower(v) == word, F.lit(n).cast("long")).otherwise(out)
    return F.when(v.rlike("^[0-9]{1,15}$"), F.try_to_number(v, F.lit("999999999999999")).cast("long")).otherwise(out)


def _days(u: Column) -> Column:
    out = None
    for unit, n in vocab.UNIT_DAYS.items():
        out = F.when(F.lower(u) == unit, F.lit(n).cast("long")) if out is None else out.when(F.lower(u) == unit, F.lit(n).cast("long"))
    return out


def for_speech(text: Column) -> Column:
    """Text without markup, for reading aloud: fixed patterns in their order, then blanks collapsed."""
    steps = (
        (r"(?s)```.*?```", " "), ("`([^`]*)`", "$1"), (r"(?s)\*\*(.+?)\*\*", "$1"), (r"(?sU)(?<!\w)\*(.+?)\*(?!\w)", "$1"),
        (r"(?sU)(?<!\w)_(.+?)_(?!\w)", "$1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s{0,3}[-*+]\s+", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"[ \t]+", " "), (r"\n{2,}", "\n"), (r"^\s+|\s+$", ""),
    )
    text = F.coalesce(text, F.lit(""))
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def token_of(kind: Column | str, value: Column) -> Column:
    """[KIND_hhhhhh], the same for values that differ in case and outer blanks only."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("["), kind, F.lit("_"), F.substring(F.sha2(F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), 256), 1, 6), F.lit("]"))


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
