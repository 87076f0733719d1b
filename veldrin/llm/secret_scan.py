"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings. DataFrame functions only.

Candidates are runs of 20 or more base64 or URL characters. A window of 20 characters slides over each; its character
counts, the sum of c * log2 c over them and the numbers of digits, letters and hex digits change with the character
that enters and the one that leaves, in fixed point, so sums are exact. A window counts if it belongs to a class and
its entropy reaches that of the class: hex digits with letters; base64 with a digit, an upper and a lower case letter;
lower case letters and digits, or upper case letters and digits, of several each.
Overlapping windows make one span; spans that match an allow-list pattern, or lie within a fixed-pattern one, go.

Positions are in code points, ends exclusive. Null and empty texts have no spans. A long candidate is cut into blocks
that overlap by a window, so no accumulator grows with it. Rows are independent: repeated rows give repeated results,
an empty table none. Extra columns pass through whatever their names, save `secrets`, which is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cleared, packed, quoted, unpacked

WINDOW = 20
BLOCK = 1024
KINDS = ("assign", "access", "hex", "entropy")
# The patterns of the kinds, each with the group that has a least length, and that length.
PATTERNS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Least bits a character, by class.
FLOORS = {"hex": 3.0, "base64": 3.75, "base36": 3.5, "base32": 3.5}
#: Least digits and least letters in a window of one case.
MIXED = 3
#: Spans with one of these are known to be harmless: UUIDs, examples, counting and repeated characters.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i)example|placeholder|changeme|dummy",
    r"0123456789|(?i)abcdefghij",
    r"(.)\1{5,}",
)
_ONE = 1 << 20


def _fold(lengths: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(lengths, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """The sum of the elements before each; in blocks, so that the arrays copied on the way stay short."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, block))
    starts = _fold(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)))
    return F.flatten(F.zip_with(parts, starts, lambda p, s: F.transform(_fold(p), lambda v: v + s)))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once: what a lambda refers to is evaluated for each element otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, hit, inner>> of the leftmost non-overlapping matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))

    def spans(p: Column) -> Column:
        gap = F.slice(p["gaps"], F.lit(1), F.size(p["hits"]))
        moved = _let(F.zip_with(gap, p["hits"], lambda g, h: g + F.length(h)), lambda v: prefix_sums(v))
        starts = F.zip_with(moved, gap, lambda m, g: m + g)
        placed = F.zip_with(starts, p["hits"], lambda s, h: F.struct(s.alias("start"), h.alias("hit")))
        return F.zip_with(placed, p["inner"], lambda a, i: F.struct(a["start"].alias("start"), a["hit"].alias("hit"), i.alias("inner")))

    none = F.array().cast("array<struct<start:bigint,hit:string,inner:string>>")
    return F.when(text.rlike(pattern), _let(F.struct(hits.alias("hits"), inner.alias("inner"), gaps.alias("gaps")), spans)).otherwise(none)


def _windows(block: Column) -> Column:
    """array<struct<s,e>>: merged spans (0-based in the block) of the windows of a block that count."""
    chars = F.transform(F.regexp_extract_all(block, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    table = F.array(*[F.lit(round(_ONE * n * math.log2(n)) if n > 1 else 0) for n in range(WINDOW + 2)])
    most = {k: round(_ONE * WINDOW * (math.log2(WINDOW) - v)) for k, v in FLOORS.items()}
    spans = F.array().cast("array<struct<s:int,e:int>>")
    zero = F.struct(
        F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0).alias("sum"), F.lit(0).alias("digits"), F.lit(0).alias("hexes"),
        F.lit(0).alias("lower"), F.lit(0).alias("upper"), F.lit(-1).alias("s"), F.lit(-1).alias("e"), spans.alias("out"))

    def lower(c: Column) -> Column:
        return (((c >= 10) & (c < 16)) | ((c >= 22) & (c < 42))).cast("int")

    def upper(c: Column) -> Column:
        return (((c >= 16) & (c < 22)) | ((c >= 42) & (c < 62))).cast("int")

    def step(a: Column, pair: Column) -> Column:
        new, old = pair["new"], pair["old"]  # old is -1 until the window is full
        n_old = F.when(old >= 0, F.element_at(a["n"], F.greatest(old, F.lit(0)) + 1)).otherwise(F.lit(0))
        n_new = F.element_at(a["n"], new + 1) - (new == old).cast("int")
        total = a["sum"] + F.when(n_old > 0, F.element_at(table, n_old) - F.element_at(table, n_old + 1)).otherwise(F.lit(0)) + F.element_at(table, n_new + 2) - F.element_at(table, n_new + 1)
        digits = a["digits"] + (new < 10).cast("int") - ((old >= 0) & (old < 10)).cast("int")
        hexes = a["hexes"] + (new < 22).cast("int") - ((old >= 0) & (old < 22)).cast("int")
        low, up = a["lower"] + lower(new) - lower(old), a["upper"] + upper(new) - upper(old)
        i = a["i"] + 1
        good = (i >= WINDOW) & (((hexes == WINDOW) & (digits > 0) & (digits < WINDOW) & (total <= most["hex"])) | ((digits > 0) & (low > 0) & (up > 0) & (total <= most["base64"]))
                              | ((digits >= MIXED) & (low >= MIXED) & (digits + low == WINDOW) & (total <= most["base36"]))
                              | ((digits >= MIXED) & (up >= MIXED) & (digits + up == WINDOW) & (total <= most["base32"])))
        joins = good & (a["e"] >= 0) & (i - WINDOW <= a["e"])
        return F.struct(
            i.alias("i"), F.when(new == old, a["n"]).otherwise(F.transform(a["n"], lambda c, k: c + (k == new).cast("int") - (k == old).cast("int"))).alias("n"),
            total.alias("sum"), digits.alias("digits"), hexes.alias("hexes"), low.alias("lower"), up.alias("upper"),
            F.when(good & ~joins, i - WINDOW).otherwise(a["s"]).alias("s"), F.when(good, i).otherwise(a["e"]).alias("e"),
            F.when(good & ~joins & (a["e"] >= 0), F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["out"]).alias("out"))

    left = F.concat(F.array_repeat(F.lit(-1), WINDOW), F.slice(chars, F.lit(1), F.greatest(F.size(chars) - WINDOW, F.lit(0))))
    pairs = F.zip_with(chars, left, lambda c, o: F.struct(c.alias("new"), o.alias("old")))
    return F.aggregate(pairs, zero, step, lambda a: F.when(a["e"] >= 0, F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["out"]))


def entropy_spans(candidate: Column) -> Column:
    """array<struct<s,e>>: merged spans of a candidate string's windows that count."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(candidate) - WINDOW, F.lit(0)), F.lit(BLOCK))
    parts = F.flatten(F.transform(starts, lambda b: F.transform(_windows(F.substring(candidate, b + 1, F.lit(BLOCK + WINDOW - 1))), lambda w: F.struct((w["s"] + b).alias("s"), (w["e"] + b).alias("e")))))
    none = F.array().cast("array<struct<s:int,e:int>>")

    def glue(a: Column, w: Column) -> Column:
        last = F.element_at(a, -1)
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["e"] >= w["s"]), F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), w["e"].alias("e"))))).otherwise(F.concat(a, F.array(w)))

    return F.aggregate(parts, none, glue)


def scan(docs: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with `secrets`, array<struct<start, kind, end>> by start and then kind (its place in KINDS)."""
    docs = cleared(docs, ["secrets"])
    body = F.coalesce(F.col("_text"), F.lit(""))
    spans = []
    for k, kind in enumerate(KINDS[:3]):
        pattern, group, least = PATTERNS[kind]
        spans.append(_long_enough(find(body, pattern, group), k, least))
    fixed = packed(docs, quoted(text).alias("_text")).withColumn("_base", F.concat(*spans)).withColumn("_cand", F.filter(find(body, CANDIDATE), lambda m: m["hit"].rlike("[0-9]")))

    def of(m: Column) -> Column:
        kept = F.filter(entropy_spans(m["hit"]), lambda w: ~_any(m["hit"].substr(w["s"] + 1, w["e"] - w["s"]), allow))
        return F.transform(kept, lambda w: F.struct((m["start"] + w["s"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + w["e"]).alias("end")))

    more = F.flatten(F.transform("_cand", of))
    more = F.filter(more, lambda w: ~F.exists("_base", lambda b: (b["start"] <= w["start"]) & (b["end"] >= w["end"])))
    done = fixed.withColumn("secrets", F.array_sort(F.concat("_base", more)))
    return done.select(*unpacked(docs.columns), "secrets")


def _long_enough(found: Column, kind: int, least: int) -> Column:
    kept = F.filter(found, lambda m: F.length(m["inner"]) >= least)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["hit"])).alias("end")))


def _count(kind: int) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the fixed-pattern spans and all spans as text."""
    counts = [_count(k).alias(f"n_{n}") for k, n in enumerate(KINDS[:3])]
    base = F.sha2(digest(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256")
    return scanned.select(id_col, *counts, base, digest(F.col("secrets")).alias("spans"))
