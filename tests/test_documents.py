"""From words and tables to sections, records and their files."""

from pyspark.sql import functions as F

from veldrin.operators import clean
from veldrin.sources import documents as D
from veldrin.sources import packs

WORD = "doc_id int, page int, text string, top double, bottom double, x0 double, x1 double"


def made(spark):
    words = []

    def line(doc, page, text, top):
        words.extend((doc, page, w, top, top + 8.0, 10.0 + 40 * i, 30.0 + 40 * i) for i, w in enumerate(text.split()))

    for page in (1, 2):
        line(1, page, "Solara Policy", 5.0)
        line(1, page, f"page {page} of 2", 990.0)
    line(1, 1, "an introduction that is long enough to be kept as it is", 100.0)
    line(1, 1, "1. Waiting Periods", 150.0)
    line(1, 1, "The waiting period is 30 days for all illness covered here.", 170.0)
    line(1, 1, "Premium Rates", 400.0)
    line(1, 1, "inside the box", 450.0)
    line(1, 2, "It goes on over the page.", 100.0)
    line(3, 1, "too short", 100.0)
    head = ["Age", "Monthly premium in pesos"]
    tables = [(1, 1, 430.0, 0.0, 900.0, 430.0, 600.0, [head, ["18", "100"], ["30", None]]), (1, 2, 20.0, 0.0, 900.0, 20.0, 60.0, [head, ["40", "300"]]), (1, 2, 500.0, 0.0, 900.0, 500.0, 600.0, [["a", "b"]])]
    heights = [(1, 1, 1000.0), (1, 2, 1000.0), (2, 1, 1000.0), (3, 1, 1000.0)]
    docs = [(1, "health_shield.pdf", None), (2, "multifinance_x.pdf", None), (3, "short.pdf", None), (4, "bad.pdf", "OSError: no")]
    return D.policy_sections(
        spark.createDataFrame(docs, "doc_id int, name string, error string"), spark.createDataFrame(words, WORD),
        spark.createDataFrame(tables, "doc_id int, page int, top double, left double, right double, upper double, lower double, rows array<array<string>>"), spark.createDataFrame(heights, "doc_id int, page int, height double"), "t")


def test_sections_and_reports(spark):
    sections, reports = made(spark)
    got = [(r.source_type, r.source_ref, r.title, r.content) for r in sections.orderBy("source_origin", "place").collect()]
    assert got == [
        ("pdf_policy", "documents/health_shield.pdf#Health Shield", "Health Shield", "an introduction that is long enough to be kept as it is"),
        ("pdf_policy", "documents/health_shield.pdf#1. Waiting Periods", "1. Waiting Periods", "The waiting period is 30 days for all illness covered here. Premium Rates It goes on over the page."),
        ("pdf_table", "documents/health_shield.pdf#Premium Rates", "Health Shield: Premium Rates", "Age | Monthly premium in pesos\n18 | 100\n30\n40 | 300")]
    by = {r.doc_id: r for r in reports.collect()}
    assert (by[1].ok, by[1].pages, by[1].tables, by[1].tables_rejoined, by[1].boilerplate_lines, by[1].sections, by[1].error) == (True, 2, 2, 1, 3, 3, None)
    assert by[2].flags == ["empty_extraction"] and by[3].error == "parsed but produced no usable sections" and by[4].flags == ["unreadable_source"] and by[4].error == "OSError: no" and not by[4].ok


def test_build_from_formats(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("version: 1\nunits:\n  life_ph:\n    hard_rules:\n      - {id: A, test: age > 1, on_fail: decline, reason: The grace period is 60 days for an early lapse}\nprohibited: [lie]\n")
    rules = packs.rule_sections(packs.scan_rules(spark, str(tmp_path)), "t")
    sections = D.extract_all(made(spark)[0], rules)
    records = clean.build_records(sections, rank=True).cache()
    ids = [r.record_id for r in records.orderBy("ord").collect()]
    assert len(ids) == 5 and [int(i.rsplit("_", 1)[1]) for i in ids] == [1, 2, 3, 4, 5] and records.where("ord <= 3").where("source_type = 'rules_file'").count() == 0
    found = clean.conflicts(records.withColumn("duplicate_of", F.lit("")))
    D.write_build(clean.apply_conflicts(records, found), found, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/records").count() == 5
