"""What a build came to, gathered by the pass that writes it: observed metrics, not a second query over the output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, metrics: dict[str, Column], form: str = "parquet", mode: str = "errorifexists") -> dict[str, object]:
    """df written, and its metrics: aggregates over its rows, without distinct ones."""
    observed = Observation()
    df.observe(observed, *[c.alias(n) for n, c in metrics.items()]).write.mode(mode).format(form).save(path)
    return observed.get


def sections() -> dict[str, Column]:
    """Of rows of html.html_sections or the like: how much was kept, of how much, by which method."""
    return {
        "sections": F.count(F.lit(1)), "kept_chars": F.sum(F.length("content")), "shortest": F.min(F.length("content")), "longest": F.max(F.length("content")), "fallbacks": F.count_if(F.col("method") != "structural"),
        "empty_titles": F.count_if(F.coalesce("title", F.lit("")) == "")}


def records() -> dict[str, Column]:
    """Of rows of store.expand."""
    return {
        "rows": F.count(F.lit(1)), "records": F.count_if(F.col("chunk_index") == 0), "superseded": F.count_if((F.col("chunk_index") == 0) & (F.coalesce("duplicate_of", F.lit("")) != "")), "retrievable": F.count_if("retrievable"),
        "shortest": F.min("char_count"), "longest": F.max("char_count"), "chars": F.sum("char_count")}


def markdown(title: str, metrics: dict[str, object], **tables: DataFrame) -> str:
    """A report of metrics, and of small tables (their first 100 rows), as text."""
    def cell(v: object) -> str:
        return "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")

    out = [f"# {title}", "", "| measure | value |", "|---|---|", *[f"| {cell(k)} | {cell(v)} |" for k, v in metrics.items()]]
    for name, df in tables.items():
        out += ["", f"## {name}", "", f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *[f"| {' | '.join(cell(v) for v in r)} |" for r in df.limit(100).collect()]]
    return "\n".join(out) + "\n"
