"""Observed counts against counts of the output; aged turns in a stream."""

import datetime

from pyspark.sql import functions as F

from veldrin.operators import reports, store
from veldrin.sources import html
from veldrin.streaming import aged


def test_metrics_are_those_of_the_output(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = reports.write(html.html_sections(pages), str(tmp_path / "s"), reports.sections())
    back = spark.read.parquet(str(tmp_path / "s"))
    want = back.agg(F.count("*"), F.sum(F.length("content")), F.min(F.length("content")), F.max(F.length("content")), F.sum((F.col("method") != "structural").cast("int")), F.sum((F.col("title") == "").cast("int"))).first()
    assert tuple(got[k] for k in ("sections", "kept_chars", "shortest", "longest", "fallbacks", "empty_titles")) == tuple(want) and got["sections"] > 0
    rows = spark.createDataFrame([(f"r{i}", f"ref{i % 4}#{'ESC-1' if i == 3 else ''}", i, "word. " * (300 * (i % 3)), "r0" if i == 5 else "", []) for i in range(9)], "record_id string, source_ref string, ord int, content string, duplicate_of string, conflicts_with array<string>")
    got = reports.write(store.expand(rows), str(tmp_path / "r"), reports.records(), "json")
    back = spark.read.json(str(tmp_path / "r"))
    assert got["rows"] == back.count() > got["records"] == back.where("chunk_index = 0").count() and got["retrievable"] == back.where("retrievable").count() and got["superseded"] == 1 and got["chars"] == back.agg(F.sum("char_count")).first()[0]
    text = reports.markdown("Build", got, lengths=back.groupBy("chunk_index").count().orderBy("chunk_index"))
    assert f"| rows | {got['rows']} |" in text and "## lengths" in text and "| 0 | " in text


def test_aged_turns_add_up(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    row = lambda c, n, s: (c, n, None if s is None else base + datetime.timedelta(seconds=s))
    parts = [[row(1, 0, 0), row(1, 1, 100), row(2, 0, 5), row(2, 1, 30)], [row(1, 2, 60), row(1, 3, 95), row(2, 2, 36), row(2, 3, None)], [row(1, 4, 131), row(2, 4, 5)]]
    schema = "conv_id long, turn long, ts timestamp"
    total = {"kept": 0, "skipped": 0}
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = aged.flagged(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        for k, n in aged.counted(q).items():
            total[k] += n
    rows = {(r.conv_id, r.turn): r.skipped for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {(1, 0): True, (1, 1): False, (2, 0): False, (2, 1): False, (1, 2): True, (1, 3): False, (2, 2): False, (1, 4): False, (2, 4): True}
    assert total == {"kept": 6, "skipped": 3}
