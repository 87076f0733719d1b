import pathlib

import pytest
from pyspark.sql import functions as F

from veldrin.sources import versions


def test_versions_and_failures(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.current(spark, path) is None
    df = spark.range(5).withColumn("p", F.col("id") % 2)
    first = versions.publish(df, path, "p", note="a")
    second = versions.publish(first.where("id > 0"), path)  # reads the version before
    assert first.count() == 5 and second.count() == versions.current(spark, path).count() == 4 and versions.pointer(spark, path)["version"] in second.inputFiles()[0]
    with pytest.raises(Exception, match="boom|USER_RAISED"):
        versions.publish(second.withColumn("x", F.raise_error(F.lit("boom"))), path)
    assert versions.current(spark, path).count() == 4
    for k in range(3):
        last = versions.publish(versions.current(spark, path).withColumn("k", F.lit(k)), path, signature="s")
    assert last.first().k == 2 and versions.pointer(spark, path)["signature"] == "s"
    kept = [p.name for p in pathlib.Path(tmp_path, "t").iterdir() if p.name.startswith("v-")]
    assert len(kept) == 2 and not [p for p in pathlib.Path(tmp_path, "t").iterdir() if p.name.startswith("_current.")]
