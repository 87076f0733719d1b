"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept, written as Parquet in the shared folder and read again. All but the
last return the columns of documents, any others that their input has included, whatever their names; n_chars follows
the text where a stage changes it:

1. language ID: trained on the labelled documents of its input; those that it rejects go;
2. line dedup: of lines within two edits of each other the first stays; documents of which no text is left go;
3. MinHash near-dedup: five-word shingles, similarity 0.8; the document with the smallest id of each group stays;
4. mixing: documents are repeated or left out as the sources' target weights ask, in order of training position;
5. packing: pieces of documents in sequences of at most 2048 tokens.

SQL can't express the stages (a trained model, hashing, a vocabulary's merges), so there is no ORACLE_SQL; tests hold
each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldrin.llm import language_id, line_dedup, minhash, mixing, packing
from veldrin.llm.common import quoted, stage

ORACLE_SQL = None


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """The columns that a stage works on, and all others in one, `row`, where their names can't clash with a stage's own."""
    others = [quoted(c) for c in docs.columns if c not in names]
    return docs.select(F.struct(*others or [F.lit(None)]).alias("row"), *[quoted(n) for n in names])


def _whole(rows: DataFrame, docs: DataFrame, *names: str, **new: Column) -> DataFrame:
    """rows that _apart(docs, *names) gave, with the columns of docs again, some of them new."""
    return rows.select(*[new[c].alias(c) if c in new else quoted(c) if c in names else F.col("row").getField(c).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    return _whole(language_id.predict(_apart(docs, "text"), model).where("accepted"), docs, "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(_apart(docs, "doc_id", "text")).where(r"n_dropped = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    new = {}
    if "n_chars" in docs.columns:
        was = F.col("row").getField("n_chars")
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(was)
    return _whole(rows, docs, "doc_id", "text", **new)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = minhash.near_duplicates(docs.select("doc_id", "text"), words=5).where("not kept").select(F.col("doc_id").alias("gone"))
    rows = _apart(docs, "doc_id")
    return _whole(rows.join(others.distinct(), F.col("doc_id") == F.col("gone"), "left_anti"), docs, "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = ("doc_id", "text", "source")
    return _whole(mixing.mix(_apart(docs, *names)), docs, *names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
