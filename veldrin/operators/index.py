"""The store's records and the vectors of those that can be found: written once, opened together, aligned by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions

# Columns that interchange formats hold as JSON.
LISTS = ("pii_types", "terminology_variants", "conflicts_with", "quality_flags")


def load_records(spark: SparkSession, path: str, retrievable_only: bool = True) -> DataFrame:
    """Records of a Parquet store; the flag is filtered in the scan. Lists held as JSON strings are decoded (what isn't
    an array of strings becomes null)."""
    rows = spark.read.parquet(path)
    if retrievable_only:
        rows = rows.where(F.col("retrievable"))
    texts = {name for name, kind in rows.dtypes if kind == "string"}
    return rows.withColumns({c: F.from_json(c, "array<string>") for c in LISTS if c in texts})


def build_index(records: DataFrame, vectors: DataFrame, path: str, signature: str) -> DataFrame:
    """The index's next version: (record_id, embedding, signature) for each of `records` that `vectors` (record_id,
    embedding) has one for. vectors may be read from an earlier version. The signature names the model, as vectors of two
    models aren't comparable."""
    ids = records.select("record_id").distinct()
    rows = vectors.join(ids, "record_id", "left_semi").select("record_id", "embedding", F.lit(signature).alias("signature"))
    return versions.publish(rows, path, signature=signature)


def open_index(records: DataFrame, index: DataFrame, signature: str) -> DataFrame:
    """Records with their vectors, joined by id and not by position; records without one, and vectors whose record has
    gone, are left out. An index of another model is an error; as one has one signature, any row tells."""
    found = index.select("signature").first()
    if found and found[0] != signature:
        raise ValueError(f"the index was built with {found[0]!r}, not {signature!r}: build it again")
    return records.join(index.select("record_id", "embedding"), "record_id")
