"""Chunks, stable ids, snapshots with versions, key-value metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import versions
from ..functions import vocab


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def chunk(text: Column, most: int = vocab.MAX_CHUNK, overlap: int = vocab.OVERLAP, least: int = vocab.MIN_CHUNK) -> Column:
    """array<string>: the text, or if it is longer than `most`, greedy runs of its sentences (of its rows, if it is a
    table), each beginning with the last pieces of the one before that fit into `overlap`; a short rest joins the last."""
    table = F.contains(text, F.lit("|")) & F.contains(text, F.lit("\n"))
    pieces = F.filter(F.when(table, F.split(text, "\n")).otherwise(X.sentences(text)), lambda p: strip(p) != "")
    gap = F.when(table, F.lit("\n")).otherwise(F.lit(" "))
    packed = X.let(F.struct(pieces.alias("pieces"), gap.alias("gap")), lambda s: _pack(s["pieces"], s["gap"], most, overlap, least))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)


def _pack(pieces: Column, gap: Column, most: int, overlap: int, least: int) -> Column:
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("cur"), F.lit(0).alias("len"))

    def step(a: Column, p: Column) -> Column:
        size = F.length(p) + 1
        full = (F.size(a["cur"]) > 0) & (a["len"] + size > most)
        t0 = F.struct(none.alias("tail"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

        def back(t: Column, q: Column) -> Column:
            stop = t["stop"] | (t["n"] + F.length(q) > overlap)
            return F.struct(F.when(stop, t["tail"]).otherwise(F.concat(F.array(q), t["tail"])).alias("tail"), F.when(stop, t["n"]).otherwise(t["n"] + F.length(q) + 1).alias("n"), stop.alias("stop"))

        tail = F.aggregate(F.when(full, F.reverse(a["cur"])).otherwise(none), t0, back)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(strip(_joined(a["cur"], gap))))).otherwise(a["done"]).alias("done"),
            F.concat(F.when(full, tail["tail"]).otherwise(a["cur"]), F.array(p)).alias("cur"),
            (F.when(full, tail["n"]).otherwise(a["len"]) + size).alias("len"))

    def finish(a: Column) -> Column:
        last = strip(_joined(a["cur"], gap))
        folds = (F.size(a["done"]) > 0) & (F.length(last) < least)
        ended = F.concat(F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.array(strip(F.concat(F.try_element_at(a["done"], F.lit(-1)), gap, last))))
        return F.filter(F.when(F.size(a["cur"]) == 0, a["done"]).when(folds, ended).otherwise(F.concat(a["done"], F.array(last))), lambda c: strip(c) != "")

    return F.aggregate(pieces, start, step, finish)


def _joined(pieces: Column, gap: Column) -> Column:
    return F.when(gap == "\n", F.array_join(pieces, "\n")).otherwise(F.array_join(pieces, " "))


def expand(records: DataFrame) -> DataFrame:
    """One row per chunk, with ids that depend on the reference alone; references to records are rewritten to the ids
    of their first chunks; duplicates and routing rules (#ESC-) aren't retrievable. Sections that share a reference
    get the section's ordinal among them in their ids, but for the first, so ids are unique."""
    same = Window.partitionBy("source_ref").orderBy("ord", "record_id")
    rows = records.withColumn("_k", F.row_number().over(same))
    rows = rows.withColumn("_ref", F.when(F.col("_k") == 1, F.col("source_ref")).otherwise(F.concat("source_ref", F.lit("~"), F.col("_k").cast("string"))))
    names = rows.select(F.col("record_id").alias("_old"), X.stable_id(F.col("_ref"), F.lit(0)).alias("_new"))
    links = rows.select("record_id", F.explode("conflicts_with").alias("_to")).join(names, F.col("_to") == F.col("_old"), "left")
    links = links.groupBy(F.col("record_id").alias("_r")).agg(F.array_sort(F.collect_set(F.coalesce("_new", "_to"))).alias("_with"))
    dup = names.select(F.col("_old").alias("_do"), F.col("_new").alias("_dn"))
    rows = rows.join(links, F.col("record_id") == F.col("_r"), "left").join(dup, F.col("duplicate_of") == F.col("_do"), "left")
    rows = rows.withColumns({
        "conflicts_with": F.coalesce("_with", F.array().cast("array<string>")), "duplicate_of": F.coalesce("_dn", "duplicate_of"),
        "retrievable": (F.coalesce("duplicate_of", F.lit("")) == "") & ~F.contains("source_ref", F.lit("#ESC-")), "_chunks": chunk(F.col("content"))})
    out = rows.select("*", F.posexplode("_chunks").alias("chunk_index", "_piece"))
    out = out.withColumns({"record_id": X.stable_id(F.col("_ref"), F.col("chunk_index")), "content": F.col("_piece"), "content_hash": X.content_hash(F.col("_piece")), "char_count": F.length("_piece"), "chunk_count": F.size("_chunks")})
    return out.drop("_k", "_ref", "_r", "_with", "_do", "_dn", "_chunks", "_piece")


def snapshot(chunks: DataFrame, before: DataFrame | None, stamp: str) -> DataFrame:
    """chunks with version, first_seen, last_updated and change (new, changed or unchanged) against the last snapshot;
    ids that no longer occur go. An unchanged record keeps its version and both dates."""
    now = F.lit(stamp)
    if before is None:
        return chunks.withColumns({"version": F.lit(1), "first_seen": now, "last_updated": now, "change": F.lit("new")})
    was = before.select(F.col("record_id").alias("_id"), F.col("version").alias("_v"), F.col("content_hash").alias("_h"), F.col("first_seen").alias("_f"), F.col("last_updated").alias("_l"))
    rows = chunks.drop("version", "first_seen", "last_updated", "change").join(was, F.col("record_id") == F.col("_id"), "left")
    new, same = F.col("_id").isNull(), F.col("_h") == F.col("content_hash")
    rows = rows.withColumns({
        "version": F.when(new, 1).when(same, F.col("_v")).otherwise(F.col("_v") + 1), "first_seen": F.when(new, now).otherwise(F.col("_f")),
        "last_updated": F.when(new | ~same, now).otherwise(F.col("_l")), "change": F.when(new, F.lit("new")).when(same, F.lit("unchanged")).otherwise(F.lit("changed"))})
    return rows.drop("_id", "_v", "_h", "_f", "_l")


def replace_table(snapshot_rows: DataFrame, path: str, partition_by: str | None = "business_unit") -> DataFrame:
    """A snapshot as the table's next version; it may read the one before, which stays until the next but one."""
    return versions.publish(snapshot_rows, path, partition_by)


def upsert(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value rows with those of `changes` put in or replaced."""
    return meta.join(changes.select(F.col("key").alias("_k")), F.col("key") == F.col("_k"), "left_anti").unionByName(changes)


def lookup(meta: DataFrame, key: str) -> str:
    row = meta.where(F.col("key") == key).select("value").first()
    return row[0] if row and row[0] is not None else ""
