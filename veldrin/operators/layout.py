"""Positioned words and tables of documents (extracted elsewhere) to lines, furniture, joined tables and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Layout limits and heading patterns.
LINE_TOLERANCE, MARGIN_BAND, REPEAT_SHARE, LEAST_SECTION = 3.0, 0.09, 0.66, 40
# What is furniture in a margin whatever it repeats: page numbers, markings, document codes.
ALWAYS = (r"(?i)^(page\s+)?\d+(\s+of\s+\d+)?$", r"(?i)(?U)\b(confidential|draft|internal use only)\b", r"^[A-Z]{2,6}-[A-Z]{2,4}-\d{4}-\d{2}\b")
# The length that a heading without a number stays under, and how it doesn't end.
LONGEST_HEADING, SENTENCE_END = 70, r"[.:;,]$"
HEADINGS = (r"^(\d+)\.\s+([A-Z][^.]{3,70})$", r"(?i)^(Pasal\s+\d+)\s*:\s*(.+)$", r"(?i)^(Section\s+\d+)\s*[:.]\s*(.+)$")


def outside_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words (doc_id, page, text, top, bottom, x0, x1) whose centre lies in no table box (doc_id, page, left, right, upper, lower)."""
    box = tables.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "left", "right", "upper", "lower")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return words.join(box, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (x >= F.col("left")) & (x <= F.col("right")) & (y >= F.col("upper")) & (y <= F.col("lower")), "left_anti")


def lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, top, bottom): a page's words from top and left; a word belongs to the current line
    if it is within the tolerance of the line's first word. A page is the unit, so the fold is short."""
    page = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.round("top", 1).alias("r"), "x0", "top", "bottom", "text"))).alias("w"))
    none = F.array().cast("array<struct<text:string,top:double,bottom:double>>")

    def step(a: Column, w: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        joins = F.coalesce(F.abs(w["top"] - last["top"]) <= LINE_TOLERANCE, F.lit(False))
        grown = F.struct(F.concat(last["text"], F.lit(" "), w["text"]).alias("text"), last["top"].alias("top"), F.greatest(last["bottom"], w["bottom"]).alias("bottom"))
        new = F.struct(w["text"].alias("text"), w["top"].alias("top"), w["bottom"].alias("bottom"))
        return F.when(joins, F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(a, F.array(new)))

    return page.select("doc_id", "page", F.posexplode(F.aggregate("w", none, step)).alias("line_no", "l")).select("doc_id", "page", "line_no", "l.*")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def mark_furniture(rows: DataFrame, heights: DataFrame) -> DataFrame:
    """lines with `furniture`: whether a line's text is that of one in the top or bottom band which ALWAYS names, or whose
    shape (digits as #) is in the bands of enough of its document's pages."""
    rows = rows.join(heights.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "height"), (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")), "left").drop("_d", "_p")
    banded = (F.col("top") < F.col("height") * MARGIN_BAND) | (F.col("bottom") > F.col("height") * (1 - MARGIN_BAND))
    rows = rows.withColumns({"_band": F.coalesce(banded, F.lit(False)), "_plain": _plain(F.col("text"))})
    own = rows.where("_band").select("doc_id", "page", "_plain", F.regexp_replace("_plain", r"\d+", "#").alias("_shape"))
    pages = heights.groupBy(F.col("doc_id").alias("_pd")).agg(F.countDistinct("page").alias("n"))
    seen = own.groupBy(F.col("doc_id").alias("_sd"), F.col("_shape").alias("_ss")).agg(F.countDistinct("page").alias("k"))
    needed = F.greatest(F.lit(2), F.floor(F.col("n") * REPEAT_SHARE))
    common = seen.join(pages, F.col("_sd") == F.col("_pd")).where((F.col("n") >= 2) & (F.col("k") >= needed)).select("_sd", "_ss", F.lit(True).alias("_c"))
    always = F.lit(False)
    for p in ALWAYS:
        always = always | F.col("_plain").rlike(p)
    named = own.join(common, (F.col("doc_id") == F.col("_sd")) & (F.col("_shape") == F.col("_ss")), "left").where(F.coalesce("_c", F.lit(False)) | always)
    named = named.select(F.col("doc_id").alias("_nd"), F.col("_plain").alias("_np")).distinct().withColumn("_f", F.lit(True))
    out = rows.join(named, (F.col("doc_id") == F.col("_nd")) & (F.col("_plain") == F.col("_np")), "left")
    return out.withColumn("furniture", F.coalesce("_f", F.lit(False))).drop("_band", "_plain", "_nd", "_np", "_f", "height")


def heading_of(text: Column) -> Column:
    """What a line says as a heading: its number and its title, or the whole of a short line that starts with a capital
    and ends no sentence; else null."""
    plain = _plain(text)
    out = F.when((plain != "") & (F.length(plain) < LONGEST_HEADING) & plain.rlike(r"^\p{Lu}") & ~plain.rlike(SENTENCE_END), plain)
    for p in reversed(HEADINGS):
        out = F.when(plain.rlike(p), F.trim(F.concat(F.regexp_extract(plain, p, 1), F.lit(" "), F.regexp_extract(plain, p, 2)))).otherwise(out)
    return out


def header_like(row: Column) -> Column:
    return F.size(F.filter(row, lambda c: ~c.rlike(r"\d"))) >= F.greatest(F.lit(1), F.size(row) - 1)


def rejoin_tables(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, page, top, rows) with those that a page break cut joined to the table that they go on: of the
    same width, on the page after its last, with its header repeated (and dropped) or without one of its own."""
    doc = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "top", "rows"))).alias("t"))
    none = F.array().cast("array<struct<page:int,top:double,last_page:int,rows:array<array<string>>>>")

    def step(a: Column, t: Column) -> Column:
        last, first = F.try_element_at(a, F.lit(-1)), F.try_element_at(t["rows"], F.lit(1))
        head = F.try_element_at(last["rows"], F.lit(1))
        repeats = first == head
        goes_on = F.coalesce((t["page"] == last["last_page"] + 1) & (F.size(first) == F.size(head)) & (repeats | ~header_like(first)), F.lit(False))
        more = F.when(repeats, F.slice(t["rows"], F.lit(2), F.greatest(F.size(t["rows"]) - 1, F.lit(0)))).otherwise(t["rows"])
        joined = F.struct(last["page"].alias("page"), last["top"].alias("top"), t["page"].cast("int").alias("last_page"), F.concat(last["rows"], more).alias("rows"))
        new = F.struct(t["page"].cast("int").alias("page"), t["top"].cast("double").alias("top"), t["page"].cast("int").alias("last_page"), t["rows"].alias("rows"))
        return F.when(goes_on, F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(a, F.array(new)))

    return doc.select("doc_id", F.posexplode(F.aggregate("t", none, step)).alias("table_no", "t")).select("doc_id", "table_no", "t.*")


def table_to_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.filter(r, lambda c: c.isNotNull() & (c != "")), " | ")), "\n")


def headings_above(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """tables (doc_id, page, top) with `heading`: of the lines that end above each on its page, the last that is a heading
    and no furniture (if rows have that column), else empty; an as-of join by union and window."""
    heading = heading_of(F.col("text"))
    if "furniture" in rows.columns:
        heading = F.when(~F.coalesce("furniture", F.lit(False)), heading)
    a = rows.select("doc_id", "page", F.col("bottom").alias("y"), F.lit(0).alias("kind"), heading.alias("_text"), F.lit(None).cast("double").alias("top"))
    b = tables.select("doc_id", "page", F.col("top").alias("y"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("_text"), F.col("top").cast("double").alias("top"))
    order = Window.partitionBy("doc_id", "page").orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("heading", F.last("_text", ignorenulls=True).over(order))
    return both.where("kind = 1").select("doc_id", "page", "top", F.coalesce("heading", F.lit("")).alias("heading"))


def is_heading(text: Column) -> Column:
    out = F.lit(False)
    for p in HEADINGS:
        out = out | text.rlike(p)
    return out


def document_sections(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fallback: Column | None = None) -> DataFrame:
    """(doc_id, section, title, content): lines under their last heading, joined by blanks; short bodies go. Within a
    row: the lines are folded where they are, nothing is shuffled."""
    parts = F.filter(F.transform(F.split(F.col(text), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    start = F.struct((fallback if fallback is not None else F.lit("")).alias("title"), F.array().cast("array<string>").alias("body"), F.array().cast("array<struct<title:string,content:string>>").alias("done"))

    def closed(a: Column) -> Column:
        body = F.array_join(a["body"], " ")
        return F.when(F.length(body) >= LEAST_SECTION, F.concat(a["done"], F.array(F.struct(a["title"].alias("title"), body.alias("content"))))).otherwise(a["done"])

    def step(a: Column, line: Column) -> Column:
        h = is_heading(line)
        return F.struct(F.when(h, line).otherwise(a["title"]).alias("title"), F.when(h, F.array().cast("array<string>")).otherwise(F.concat(a["body"], F.array(line))).alias("body"), F.when(h, closed(a)).otherwise(a["done"]).alias("done"))

    return docs.select(F.col(id_col), F.posexplode(F.aggregate(parts, start, step, closed)).alias("section", "s")).select(id_col, "section", "s.title", "s.content")
