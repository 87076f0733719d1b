"""Personal data: spans, stable tokens, redaction, counts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from ..functions import vocab

FINDINGS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("text", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("replacement", T.StringType()))]))
_PATTERNS = [(k, re.compile(p)) for k, p in vocab.PII]
_NAME = re.compile(vocab.NAME)
_STOP = frozenset(vocab.NOT_A_NAME)


def _person(candidate: str) -> bool:
    words = [w.strip(".,'") for w in candidate.split()]
    return 2 <= len(words) <= 4 and not any(w.lower() in _STOP for w in words) and all(2 <= len(w) <= 15 for w in words)


def find(text: str | None, names: bool) -> list[tuple[str, str, int, int, str]]:
    """Non-overlapping spans; kinds claim them in order, so a later kind's match that overlaps is left out."""
    taken: list[tuple[str, str, int, int, str]] = []
    for kind, pattern in [*_PATTERNS, *([("NAME", _NAME)] if names else [])]:
        for m in pattern.finditer(text or ""):
            s, e = m.span()
            if (kind != "NAME" or _person(m.group())) and all(e <= t[2] or s >= t[3] for t in taken):
                digest = hashlib.sha256(m.group().strip().lower().encode()).hexdigest()[:6]
                taken.append((kind, m.group(), s, e, f"[{kind}_{digest}]"))
    return sorted(taken, key=lambda t: t[2])


@pandas_udf(FINDINGS)
def findings(text: pd.Series) -> pd.Series:
    return text.map(lambda t: find(t, False))


@pandas_udf(FINDINGS)
def findings_with_names(text: pd.Series) -> pd.Series:
    return text.map(lambda t: find(t, True))


def redacted(text: Column, found: Column) -> Column:
    """text with the spans found replaced by their tokens."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        found, start, lambda a, f: F.struct(f["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, f["start"] - a["at"]), f["replacement"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def protect(records: DataFrame, column: str = "content", names: bool = False) -> DataFrame:
    """records with the column redacted, pii (any found), pii_types and pii_findings. Patterns are only tried on texts
    that hold a digit, an @ or a street word, unless names are wanted: the others can have no match."""
    found = findings_with_names if names else findings
    worth = F.lit(True) if names else F.col(column).rlike(r"[0-9@]|(?i)jl\.|jalan|block|blk|unit|purok|barangay|brgy|npwp")
    rows = records.withColumn("pii_findings", F.coalesce(found(F.when(worth, F.col(column))), F.array().cast(FINDINGS)))
    rows = rows.withColumn(column, redacted(F.col(column), F.col("pii_findings")))
    return rows.withColumn("pii", F.size("pii_findings") > 0).withColumn("pii_types", F.array_sort(F.array_distinct(F.transform("pii_findings", lambda f: f["kind"]))))


def contains_personal_data(text: Column) -> Column:
    out = F.lit(False)
    for _, pattern in vocab.PII:
        out = out | text.rlike(pattern)
    return out


def counts(protected: DataFrame) -> DataFrame:
    """Findings and rows touched, by kind."""
    kinds = F.array_distinct(F.transform("pii_findings", lambda f: f["kind"]))
    rows = protected.select(F.explode(kinds).alias("kind"), "pii_findings")  # a row for each kind of a record
    return rows.groupBy("kind").agg(F.sum(F.size(F.filter("pii_findings", lambda f: f["kind"] == F.col("kind")))).alias("n"), F.count("*").alias("rows_touched"))


def score(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Recall, mean coverage and spurious findings by kind, from expected (row, kind, value) and found (row, kind, text).

    A value is caught by a finding of its kind in its row that contains it or is contained in it; its coverage is the
    longest such finding's share of its length, 1 at most. Kinds without expected values have recall 1 and coverage 0.
    """
    hit = (F.col("e.row") == F.col("f.row")) & (F.col("e.kind") == F.col("f.kind")) & (F.contains(F.col("f.text"), F.col("e.value")) | F.contains(F.col("e.value"), F.col("f.text")))
    e, f = expected.alias("e"), found.alias("f")
    caught = e.join(f, hit, "left").groupBy("e.row", "e.kind", "e.value").agg(F.max(F.length("f.text")).alias("longest"))
    by = caught.groupBy("kind").agg(F.count("*").alias("expected"), F.count("longest").alias("caught"), F.avg(F.when(F.col("longest").isNotNull(), F.least(F.lit(1.0), F.col("longest") / F.length("value")))).alias("coverage"))
    spurious = f.join(e, hit, "left_anti").groupBy("kind").agg(F.count("*").alias("spurious"))
    out = by.join(spurious, "kind", "full_outer").na.fill(0, ["expected", "caught", "spurious"])
    return out.select("kind", "expected", "caught", F.when(F.col("expected") > 0, F.col("caught") / F.col("expected")).otherwise(1.0).alias("recall"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "spurious")


def redact_files(texts: Iterator[str]) -> Iterator[str]:
    """The same redaction, for single texts on the driver."""
    for text in texts:
        out, at = [], 0
        for _, _, s, e, new in find(text, True):
            out += [text[at:s], new]
            at = e
        yield "".join([*out, text[at:]])
