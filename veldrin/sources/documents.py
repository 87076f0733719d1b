"""Documents whose words and tables were extracted elsewhere, to sections and reports; formats put together; records and
contradictions written.

words (doc_id, page, text, top, bottom, x0, x1), tables (doc_id, page, top, left, right, upper, lower, rows), heights
(doc_id, page, height) and documents (doc_id, name, error: what kept one from being read, or null) are what a PDF reader
gives. A document that couldn't be read, or that holds no text, is a row of the reports and has no sections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from .files import write_json

LEAST = 40
LABEL = 60
#: Names that are in Indonesian.
INDONESIAN = "multifinance"


def _title(name: Column) -> Column:
    return F.initcap(F.replace(_stem(name), F.lit("_"), F.lit(" ")))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def policy_sections(documents: DataFrame, words: DataFrame, tables: DataFrame, heights: DataFrame, retrieved_at: str) -> tuple[DataFrame, DataFrame]:
    """Sections of running text and of tables, and a report for each document; `place` is a section's order in its own."""
    one = documents.select(F.col("doc_id").alias("_id"), F.col("name").alias("_name"), F.col("error").alias("_error"))
    lines = layout.mark_furniture(layout.lines(layout.outside_tables(words, tables)), heights)
    kept = lines.where("not furniture").select("doc_id", F.struct("page", "line_no", layout._plain(F.col("text")).alias("t")).alias("l"))
    bodies = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "\n").alias("text"))
    bodies = bodies.join(one, F.col("doc_id") == F.col("_id")).where("_error is null").select("doc_id", "text", "_name")
    running = layout.document_sections(bodies.select(F.struct("doc_id", F.col("_name").alias("name")).alias("d"), "text", _title(F.col("_name")).alias("_fallback")), "d", "text", F.col("_fallback"))
    origin = lambda name: F.concat(F.lit("documents/"), name)

    def rows(df: DataFrame, kind: str, name: Column, ref: Column, level: int, method: str, place: list[Column]) -> DataFrame:
        return df.select(
            F.lit(kind).alias("source_type"), F.concat(origin(name), F.lit("#"), ref).alias("source_ref"), origin(name).alias("source_origin"), "title", "content", F.lit(level).alias("heading_level"),
            F.when(F.contains(_stem(name), F.lit(INDONESIAN)), F.lit("id")).otherwise(F.lit("en")).alias("language"), F.lit(retrieved_at).alias("retrieved_at"), F.lit(method).alias("extraction_method"),
            F.length("content").alias("char_count"), F.array().cast("array<string>").alias("quality_flags"), F.array(*place).alias("place"))

    text = rows(running, "pdf_policy", F.col("d.name"), F.col("title"), 2, "words", [F.lit(0), F.col("section")])
    joined = layout.rejoin_tables(tables.select("doc_id", F.col("page").cast("int").alias("page"), F.col("top").cast("double").alias("top"), "rows"))
    above = layout.headings_above(joined.select("doc_id", "page", "top").distinct(), lines).select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("top").alias("_t"), "heading")
    found = joined.join(above, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col("top") == F.col("_t")), "left").join(one, F.col("doc_id") == F.col("_id")).where("_error is null")
    number = F.concat(F.lit("able "), (F.col("table_no") + 1).cast("string"))
    label = F.substring(F.array_join(F.filter(F.element_at("rows", 1), lambda c: c.isNotNull() & (c != "")), " "), 1, LABEL)
    heading = F.nullif(F.coalesce("heading", F.lit("")), F.lit(""))
    titled = F.concat(_title(F.col("_name")), F.lit(": "), F.coalesce(heading, F.nullif(label, F.lit("")), F.concat(F.lit("T"), number)))
    found = found.select("doc_id", "_name", "table_no", "rows", titled.alias("title"), layout.table_to_text(F.col("rows")).alias("content"), F.coalesce(heading, F.concat(F.lit("t"), number)).alias("_ref"))
    tabled = rows(found.where(F.length("content") >= LEAST), "pdf_table", F.col("_name"), F.col("_ref"), 3, "tables", [F.lit(1), F.col("table_no")])
    sections = text.unionByName(tabled)

    def counted(df: DataFrame, key: str, name: str, value: Column | None = None) -> DataFrame:
        return df.groupBy(F.col(key).alias(f"_{name}_id")).agg((F.count("*") if value is None else value).alias(name))

    counts = [
        counted(heights, "doc_id", "pages"), counted(tables, "doc_id", "raw_tables"), counted(joined, "doc_id", "tables"), counted(lines.where("furniture"), "doc_id", "boilerplate_lines", F.countDistinct(layout._plain(F.col("text")))),
        counted(lines.where("trim(text) <> ''"), "doc_id", "lines")]
    report = reduce(lambda d, c: d.join(c, F.col("_id") == F.col(c.columns[0]), "left").drop(c.columns[0]), counts, one)
    by_origin = sections.groupBy(F.col("source_origin").alias("_o")).agg(F.count("*").alias("sections"))
    report = report.join(by_origin, origin(F.col("_name")) == F.col("_o"), "left").na.fill(0, ["pages", "raw_tables", "tables", "boilerplate_lines", "lines", "sections"])
    empty = F.col("lines") == 0
    flags = F.array_compact(F.array(F.when(F.col("_error").isNotNull(), F.lit("unreadable_source")), F.when(F.col("_error").isNull() & empty, F.lit("empty_extraction"))))
    error = F.coalesce("_error", F.when(empty, F.lit("no extractable text, possibly a scanned document")), F.when(F.col("sections") == 0, F.lit("parsed but produced no usable sections")))
    return sections, report.select(
        F.col("_id").alias("doc_id"), origin(F.col("_name")).alias("origin"), (F.col("sections") > 0).alias("ok"), "pages", "tables", (F.col("raw_tables") - F.col("tables")).alias("tables_rejoined"), "boilerplate_lines", "sections", error.alias("error"), flags.alias("flags"))


def extract_all(*formats: DataFrame) -> DataFrame:
    """Sections of several formats as one, in the order given: `source_order` sorts by format, origin and place."""
    def ordered(df: DataFrame, n: int) -> DataFrame:
        place = F.transform(F.col("place"), lambda p: p.cast("long")) if "place" in df.columns else F.array().cast("array<long>")
        return df.withColumn("source_order", F.struct(F.lit(n).alias("format"), F.col("source_origin").alias("origin"), place.alias("place"), F.col("source_ref").alias("ref"))).drop("place")

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [ordered(df, n) for n, df in enumerate(formats)])


def write_build(records: DataFrame, conflicts: DataFrame, path: str) -> None:
    """Records and contradictions as JSON lines, `records` and `conflicts` under path."""
    write_json(records, f"{path}/records")
    write_json(conflicts, f"{path}/conflicts")
