"""Global ranks without a global sort in one task: rows are dealt into ranges, sorted and numbered there, and each range
starts where those before it end.

The sorted rows are written once, so that counts and numbers are of the same ranges; what is summed over ranges is one
count for each. Rows that the order leaves tied get ranks of some order; a total order makes them stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

#: monotonically_increasing_id: the partition above these bits, the row's place in it below.
_PLACE_BITS = 33


def ranked(df: DataFrame, *order: str | Column, name: str = "rank", ranges: int | None = None) -> DataFrame:
    """df with `name`, 1 to the number of rows in the order given. A column of that name is replaced; nulls sort as Spark has them."""
    cols = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.drop(name).repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    rows = written(dealt.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]).alias("row"), F.monotonically_increasing_id().alias("at")), "ranges")
    part = F.shiftright("at", _PLACE_BITS)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    out = rows.withColumn("_p", part).join(F.broadcast(before), F.col("_p") == F.col("part"))
    place = F.col("at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c != name], (F.col("before") + place + 1).alias(name))
