"""Readers and writers of the files between stages: JSON lines, CSV forms, rules, records; Spark does the reading."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION = "source_type string, source_ref string, source_origin string, title string, content string, heading_level int, language string, retrieved_at string, extraction_method string, char_count int, quality_flags array<string>"

# Slots that say who a caller is; and names that other packs may give them.
CONTACTS = ("full_name", "contact_number", "email", "name", "phone", "address")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_sections(spark: SparkSession, paths: list[str], schema: str = SECTION) -> DataFrame:
    """JSON lines of the files that are there, in the files' order; a missing one is passed over, blank lines too."""
    parts = [spark.read.schema(schema).json(p).withColumn("file_order", F.lit(i)) for i, p in enumerate(paths) if exists(spark, p)]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema + ", file_order int")


def read_required(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: run the stage before first")
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_form(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export, every column text."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def form_profile(form: DataFrame, listed: list[str] = ()) -> DataFrame:
    """One row: columns, rows, non-blank counts by column, and the distinct values of the listed columns, sorted.
    Customers' rows never leave."""
    filled = F.map_from_arrays(F.array(*[F.lit(c) for c in form.columns]), F.array(*[F.sum(F.when(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "", 1).otherwise(0)) for c in form.columns]))
    values = [F.array_sort(F.collect_set(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")))).alias(f"values_{c}") for c in listed]
    return form.agg(F.lit(len(form.columns)).alias("n_columns"), F.count("*").alias("n_rows"), filled.alias("filled"), *values)


def rules_text(rules: DataFrame, per: str = "unit") -> DataFrame:
    """Rules (unit, kind, ord, id, test, reason) as readable text, a row per unit and kind."""
    line = F.concat_ws(" ", F.concat("id", F.lit(":")), "test", F.concat(F.lit("("), "reason", F.lit(")")))
    rows = rules.groupBy(per, "kind").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))
    return rows.select(per, "kind", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"))


def without_contacts(collected: Column, private: tuple[str, ...] = CONTACTS) -> Column:
    return F.transform_values(collected, lambda k, v: F.when(k.isin(*private), F.lit("[redacted]")).otherwise(v))


def leads(spark: SparkSession, rows: DataFrame, working: str, evidence: str, private: tuple[str, ...] = CONTACTS) -> None:
    """Two writes of one set of leads: the working copy, and the evidence without contact fields."""
    redacted = rows.withColumn("collected", without_contacts(F.col("collected"), private))
    held = F.exists(F.map_keys("collected"), lambda k: k.isin(*private))
    write_json(rows, working)
    write_json(redacted.withColumn("contact_held", held), evidence)


def log_lines(rows: DataFrame) -> DataFrame:
    """A JSON line a row, nulls left out."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("value"))


TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
