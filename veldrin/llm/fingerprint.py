"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs. DataFrame functions only.

A paragraph, a stretch between line ends cut further after sentence ends, is hashed to LANES signed 16-bit numbers; a
text's fingerprint is their sum, lane by lane, modulo 2**32. So the order of paragraphs doesn't matter, equal multisets
have equal fingerprints, and adding or removing a paragraph adds or subtracts its vector. As the components have mean
zero, the inner product of two fingerprints estimates how many paragraphs (with multiplicity) two texts share; its
cosine, cut to 0 to 1, is their likeness, with an error of about 1 / sqrt(LANES).

Null is read as the empty text, whose fingerprint is zero; zero is wholly like zero and wholly unlike all else. Texts
that differ only in white space between paragraphs, or in their order, are equal by design. Repeated rows are
documents of their own. Extra columns pass through, except ones named like the columns that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cleared

LANES = 64
#: Paragraph ends: line ends, and a white-space character after a sentence's end with up to three closing characters.
CUT = r"\n+|[\x20\x09\x0B-\x0D](?<=[.!?][^\x20\x09-\x0D]{0,3}[\x20\x09-\x0D])"
_MASK = (1 << 32) - 1


def paragraphs(text: Column) -> Column:
    return F.split(text, CUT, -1)


def lanes(parts: Column) -> Column:
    """array<bigint>, the lanes of the sum, modulo 2**32, of the vectors of the paragraphs (empty ones count nothing).

    Each of LANES / 4 64-bit hashes of a paragraph gives four components. The number comes first: its hash is the seed of
    the paragraph's, so all hashes read the whole paragraph and none follows from another.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(f"l{i}") for i in range(4)])

    def add(a: Column, h: Column) -> Column:
        return F.struct(*[(a[f"l{i}"] + F.shiftright(F.shiftleft(h, 48 - 16 * i), 48)).alias(f"l{i}") for i in range(4)])

    def four(j: int) -> Column:
        hashes = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(F.lit(j), p))
        return F.aggregate(hashes, zero, add, lambda a: F.array(*[a[f"l{i}"].bitwiseAND(F.lit(_MASK)) for i in range(4)]))

    return F.flatten(F.array(*[four(j) for j in range(LANES // 4)]))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the union of two multisets; with sign -1, of a without b."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(_MASK)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of two fingerprints, lanes read as signed numbers; 1 exactly where they are equal."""
    def dot(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: _signed(p) * _signed(q))
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a == b, F.lit(1.0)).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(F.lit(0.0))


def _signed(lane: Column) -> Column:
    return F.when(lane >= 1 << 31, lane - (1 << 32)).otherwise(lane).cast("double")


def as_text(lane_array: Column) -> Column:
    return F.lower(F.array_join(F.transform(lane_array, lambda v: F.lpad(F.hex(v), 8, "0")), ""))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `lanes`, the fingerprint as numbers, and `fingerprint`, the same in hex."""
    docs = cleared(docs, ["lanes", "fingerprint", "_parts"]).withColumn("_parts", paragraphs(F.coalesce(F.col(text), F.lit(""))))
    return docs.withColumn("lanes", lanes(F.col("_parts"))).drop("_parts").withColumn("fingerprint", as_text(F.col("lanes")))


def changes(before: str, after: str, kept: str) -> tuple[Column, Column]:
    """The paragraphs that went and those that came, of paragraph columns `before` and `after` of two texts that both
    begin with the text whose paragraphs are `kept`; its last one may go on in either."""
    gone = F.slice(before, F.size(kept), F.greatest(F.size(before) - F.size(kept) + 1, F.lit(0)))
    come = F.slice(after, F.size(kept), F.greatest(F.size(after) - F.size(kept) + 1, F.lit(0)))
    return gone, come


def with_next(docs: DataFrame, id_col: str, columns: list[str], ranges_a_partition: int = 4) -> DataFrame:
    """docs with `next_<column>` of the next row by descending id; after the last comes the first. Ties by the text.

    Ids are cut into ranges at quantiles, which alone go to the driver, with the largest id of each; rows meet within a
    range, and the rows with a range's largest id go to the range above too, as the next of its last row. So rows with
    their texts are shuffled once, and no task gets more than some ranges. Null ids come last.
    """
    key = F.col(id_col)
    ids = docs.select(key.alias("_i")).where("_i is not null")
    parts = ranges_a_partition * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(ids.approxQuantile("_i", [i / parts for i in range(1, parts)], 1 / (4 * parts))))
    limits = F.array(*[F.lit(c).cast("double") for c in cuts]) if cuts else F.array().cast("array<double>")
    # range 0 holds nulls; a bisection over the cuts, so that many ranges cost little
    def bucket(v: Column) -> Column:
        lo, hi = F.lit(0), F.lit(len(cuts))
        pair = F.struct(lo.alias("lo"), hi.alias("hi"))

        def halve(p: Column, _: Column) -> Column:
            mid = F.floor((p["lo"] + p["hi"]) / 2).cast("int")
            right = F.coalesce(F.try_element_at(limits, mid + 1) <= v.cast("double"), F.lit(False))
            done = p["lo"] >= p["hi"]
            return F.struct(F.when(~done & right, mid + 1).otherwise(p["lo"]).alias("lo"), F.when(~done & ~right, mid).otherwise(p["hi"]).alias("hi"))

        found = F.aggregate(F.sequence(F.lit(0), F.lit(max(1, len(cuts)).bit_length())), pair, halve, lambda p: p["lo"])
        return F.when(v.isNull(), F.lit(0)).otherwise(found + 1)

    tops = {r["b"]: r["top"] for r in docs.select(bucket(key).alias("b"), key.alias("_i")).groupBy("b").agg(F.max("_i").alias("top")).collect()}
    order = sorted(tops)
    above = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}  # the range whose last row is followed by b's first
    rows = docs.withColumn("_b", bucket(key))
    if order:
        top = F.create_map(*[F.lit(x) for b in order for x in (b, tops[b])]) if len(order) > 1 or tops[order[0]] is not None else None
        goes = F.create_map(*[F.lit(x) for b in order for x in (b, above[b])])
        first = (key.isNull() if top is None else key.eqNullSafe(F.element_at(top, F.col("_b"))))
        both = F.array(F.struct(F.col("_b").alias("to"), F.lit(0).alias("ghost")), F.struct(F.element_at(goes, F.col("_b")).alias("to"), F.lit(1).alias("ghost")))
        rows = rows.withColumn("_to", F.explode(F.when(first, both).otherwise(F.slice(both, 1, 1))))
    else:
        rows = rows.withColumn("_to", F.struct(F.lit(0).alias("to"), F.lit(0).alias("ghost")))
    rows = rows.select("*", F.col("_to.to").alias("_at"), F.col("_to.ghost").alias("_ghost")).drop("_b", "_to")
    order_by = Window.partitionBy("_at").orderBy("_ghost", F.col(id_col).desc_nulls_last(), *columns)
    return rows.withColumns({f"next_{c}": F.lead(c).over(order_by) for c in columns}).where("_ghost = 0").drop("_at", "_ghost")


def edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and likenesses; see the query op10."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_parts", paragraphs(F.col("text"))).withColumn("lanes", lanes(F.col("_parts"))).drop("_parts")
    rows = with_next(rows, id_col, ["text", "lanes"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("_kept", F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_cut")).cast("int")))
    rows = rows.withColumn("_edited", F.concat("_kept", F.substring("next_text", F.lit(1), F.col("_cut"))))
    rows = rows.withColumns({f"_p_{c}": paragraphs(F.col(c)) for c in ("text", "_kept", "_edited")})
    gone, come = changes("_p_text", "_p__edited", "_p__kept")
    rows = rows.withColumns({"_gone": gone, "_come": come}).withColumns({"_gone": lanes(F.col("_gone")), "_come": lanes(F.col("_come"))})
    rows = rows.withColumn("_new", combine(combine(F.col("lanes"), F.col("_gone"), -1), F.col("_come")))
    return rows.select(
        id_col, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("_new")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"))
