from pyspark.sql import functions as F

from veldrin.operators import clean, layout, retrieval
from veldrin.sources import files, html

PAGE = """<html lang="en-GB"><head><title>Plans | Site</title></head><body><nav><p>menu item that is long enough to count as text</p></nav><main>
<h1>Cover</h1><p>The plan covers <b>hospital</b> stays and more than that, as written here [3].
<h2>Rates</h2><table><tr><th>Plan</th><th>Price</th></tr><tr><td>Basic</td><td>1,180</td></tr><tr><td>Plus</td><td>2,340</td></tr></table>
<ul><li><p>nested paragraph in a list that is counted once only</p></li><li>second</li></ul><h3>Empty</h3><div class="sidebar"><p>gone gone gone gone gone gone gone gone gone gone</p></div></main><footer>x</footer></body></html>"""


def test_html(spark):
    got = html.sections(PAGE, "web/x")
    assert [(g[1], g[2], g[4], g[5]) for g in got] == [(1, "Cover", "en", "structural"), (2, "Rates", "en", "structural")] and got[0][7] >= 1
    assert got[0][3] == "The plan covers hospital stays and more than that, as written here ."
    assert got[1][3] == "Plan | Price\nBasic | 1,180\nPlus | 2,340\nnested paragraph in a list that is counted once only second"
    assert html.sections("", "o") == [] and html.sections("<p>" * 3000 + "x", "o") == []
    df = html.html_sections(spark.createDataFrame([(1, "http://h/p", PAGE), (2, None, None)], "page_id long, url string, html string"))
    rows = html.as_sections(df, "t").collect()
    assert [r.source_ref for r in rows] == ["h/p#Cover", "h/p#Rates"]


def test_layout(spark):
    words = [(1, 1, "b", 10.0, 20.0, 50.0, 55.0), (1, 1, "a", 11.0, 21.0, 10.0, 15.0), (1, 1, "c", 30.0, 40.0, 10.0, 15.0), (1, 1, "in", 100.0, 110.0, 10.0, 20.0)]
    df = spark.createDataFrame(words, "doc_id int, page int, text string, top double, bottom double, x0 double, x1 double")
    box = spark.createDataFrame([(1, 1, 0.0, 50.0, 90.0, 120.0)], "doc_id int, page int, left double, right double, upper double, lower double")
    rows = layout.lines(layout.outside_tables(df, box)).orderBy("line_no").collect()
    assert [r.text for r in rows] == ["b a", "c"]
    pages = [(1, p, "Page %d" % p, 5.0, 9.0) for p in (1, 2, 3)] + [(1, p, "body %s" % "xyz"[p - 1], 50.0, 60.0) for p in (1, 2, 3)] + [(1, 1, "Title", 4.0, 8.0)]
    marked = layout.mark_furniture(spark.createDataFrame(pages, "doc_id int, page int, text string, top double, bottom double"), spark.createDataFrame([(1, p, 100.0) for p in (1, 2, 3)], "doc_id int, page int, height double"))
    assert sorted(r.text for r in marked.where("furniture").collect()) == ["Page 1", "Page 2", "Page 3"]
    tables = [(1, 1, 10.0, [["A", "B"], ["x", "1"]]), (1, 2, 5.0, [["A", "B"], ["y", "2"]]), (1, 3, 5.0, [["7", "3"]]), (1, 3, 50.0, [["C", "D"], ["w", "9"]]), (1, 5, 5.0, [["v", "8"]])]
    got = layout.rejoin_tables(spark.createDataFrame(tables, "doc_id int, page int, top double, rows array<array<string>>"))
    assert [r.t for r in got.orderBy("table_no").select(layout.table_to_text(F.col("rows")).alias("t")).collect()] == ["A | B\nx | 1\ny | 2\n7 | 3", "C | D\nw | 9", "v | 8"]
    lines = spark.createDataFrame([(1, 1, "One", 1.0, 2.0), (1, 1, "Two", 3.0, 4.0), (1, 1, "three", 5.0, 6.0), (1, 1, "A sentence.", 7.0, 8.0), (1, 1, "After", 20.0, 21.0), (1, 2, "2.  Rates of 2024", 1.0, 2.0), (1, 3, "DRAFT", 1.0, 2.0)], "doc_id int, page int, text string, top double, bottom double")
    above = layout.headings_above(spark.createDataFrame([(1, 1, 10.0), (1, 2, 10.0), (1, 3, 10.0), (1, 4, 1.0)], "doc_id int, page int, top double"), lines.withColumn("furniture", F.col("text") == "DRAFT"))
    assert {r.page: r.heading for r in above.collect()} == {1: "Two", 2: "2 Rates of 2024", 3: "", 4: ""}
    single = spark.createDataFrame([(1, 1, "page 3 of 9", 1.0, 2.0), (1, 1, "Confidential  draft", 96.0, 99.0), (1, 1, "AB-CD-2024-01 v2", 1.0, 2.0), (1, 1, "Page", 1.0, 2.0), (1, 1, "page 3 of 9", 50.0, 52.0), (1, 1, "draft law", 50.0, 52.0)], "doc_id int, page int, text string, top double, bottom double")
    got = layout.mark_furniture(single, spark.createDataFrame([(1, 1, 100.0)], "doc_id int, page int, height double"))
    assert sorted((r.text, r.top, r.furniture) for r in got.collect()) == [("AB-CD-2024-01 v2", 1.0, True), ("Confidential  draft", 96.0, True), ("Page", 1.0, False), ("draft law", 50.0, False), ("page 3 of 9", 1.0, True), ("page 3 of 9", 50.0, True)]
    doc = "intro " * 10 + "\n1. Definitions\n" + "meaning of words " * 4 + "\nPasal 2: Denda\nshort"
    got = layout.document_sections(spark.createDataFrame([(1, doc)], "doc_id int, text string"), fallback=F.lit("f")).collect()
    assert [r.title for r in got] == ["f", "1. Definitions"]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("web_page", "r", "t")], "source_type string, source_ref string, title string")
    files.write_json(rows, f"{tmp_path}/a")
    got = files.read_sections(spark, [f"{tmp_path}/none", f"{tmp_path}/a"])
    assert got.count() == 1 and got.first().content is None
    (tmp_path / "f.csv").write_text('Name,Notes\nx,"a, b"\ny,\n')
    profile = files.form_profile(files.read_form(spark, f"{tmp_path}/f.csv"), ["Name"]).first()
    assert (profile.n_columns, profile.n_rows, profile.filled, profile.values_Name) == (2, 2, {"Name": 2, "Notes": 1}, ["x", "y"])
    leads = spark.createDataFrame([(1, {"name": "Ann", "age": "30"})], "lead_id int, collected map<string,string>")
    files.leads(spark, leads, f"{tmp_path}/w", f"{tmp_path}/e")
    assert "Ann" not in "".join(p.read_text() for p in (tmp_path / "e").glob("*.json")) and spark.read.json(f"{tmp_path}/e").first().contact_held


def test_fusion_and_gate(spark):
    kw = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "query_id int, id string, rank int")
    vec = spark.createDataFrame([(1, "b", 0, 0.9), (1, "c", 1, 0.6), (1, "gone", 2, 0.95)], "query_id int, id string, rank int, score double")
    records = spark.createDataFrame([("a", "promotional", "group", [], "ref a", "A"), ("b", "binding", "u", [], "ref b", "B"), ("c", "binding", "v", ["contradicts_binding_source"], "ref c", "C")], "record_id string, authority string, business_unit string, quality_flags array<string>, source_ref string, title string")
    asked = spark.createDataFrame([(1, "u"), (2, None)], "query_id int, business_unit string")
    top = retrieval.results(retrieval.fuse(kw, vec), records, asked)
    got = {r.id: r.score for r in top.collect()}
    assert set(got) == {"a", "b"} and abs(got["b"] - (1 / 62 + 1 / 61 + 0.05 * 0.8)) < 1e-12 and abs(got["a"] - 0.35 / 61) < 1e-12
    out = {r.query_id: r for r in retrieval.outcomes(top, asked, 0.6).collect()}
    assert out[1].confident and out[1].best_similarity == 0.9 and not out[2].confident and out[2].reason == "nothing matched"
    cases = spark.createDataFrame([(1, "REF B", False), (2, "x", True)], "query_id int, expect string, decline boolean")
    assert {r.query_id: r.verdict for r in retrieval.verdicts(top, retrieval.outcomes(top, asked, 0.6), cases).collect()} == {1: "correct", 2: "correct"}


def test_groups_are_components(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(base)), (2, " ".join(base[:57] + ["q1", "q2", "q3"])), (3, " ".join(base)), (4, "other words here entirely different from it"), (5, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {tuple(r)[:2] for r in clean.similar_pairs(df, "doc_id", "text").collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r.id, r.component) for r in clean.duplicate_groups(df, "doc_id", "text").collect()} == {(1, 1), (2, 1), (3, 1)}
