"""Queries of what texts say: personal data, signals, readings. Events stand for texts, chosen by their ids; the SQL has
what each text comes to, stated by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab
from ..operators import clean, conversation, layout, nudges, privacy, signals, speech
from .catalogue import query, table


def _said(spark: SparkSession, sf_dir: str, texts: list[str], name: str = "text") -> DataFrame:
    at = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % len(texts) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", at.alias(name))


PERSONAL = [
    "mail ann@example.com or call 0917 555 1234", "TIN 123-456-789 born 1/2/1990", "KTP 1234567890123456 and HS-2024-12345", "lives at 12 Rizal Street, Quezon City now", "nothing to hide here",
    "+62 812 3456 789 twice +62 812 3456 789", "MAIL ANN@EXAMPLE.COM", "at Jl. Merdeka 5, Bandung from 3/4/2001"]
PERSONAL_SQL = """
WITH found(k, kind, value) AS (VALUES
  (0, 'EMAIL', 'ann@example.com'), (0, 'PHONE_PH', '0917 555 1234'), (1, 'GOV_ID_PH', 'TIN 123-456-789'), (1, 'DOB', '1/2/1990'), (2, 'GOV_ID_ID', 'KTP 1234567890123456'), (2, 'ACCOUNT', 'HS-2024-12345'),
  (3, 'ADDRESS', '12 Rizal Street, Quezon City'), (5, 'PHONE_ID', '+62 812 3456 789'), (5, 'PHONE_ID', '+62 812 3456 789'), (6, 'EMAIL', 'ANN@EXAMPLE.COM'), (7, 'DOB', '3/4/2001'), (7, 'ADDRESS', 'Jl. Merdeka 5, Bandung from')),
frame(k, parts) AS (VALUES (0, ['mail ', ' or call ', '']), (1, ['', ' born ', '']), (2, ['', ' and ', '']), (3, ['lives at ', ' now']), (4, ['nothing to hide here']), (5, ['', ' twice ', '']), (6, ['MAIL ', '']), (7, ['at ', ' ', ''])),
token AS (SELECT k, kind, value, '[' || kind || '_' || substr(sha256(lower(value)), 1, 6) || ']' AS t FROM found)
"""


@query(PERSONAL_SQL + """,
one AS (SELECT k, list(t ORDER BY CASE WHEN k = 7 THEN kind WHEN kind IN ('EMAIL', 'GOV_ID_PH', 'GOV_ID_ID') THEN '0' ELSE '1' END) AS toks, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, count(*) AS n FROM token GROUP BY k)
SELECT event_id, CASE len(parts) WHEN 1 THEN parts[1] WHEN 2 THEN parts[1] || toks[1] || parts[2] ELSE parts[1] || toks[1] || parts[2] || toks[2] || parts[3] END AS redacted, n IS NOT NULL AS pii, coalesce(kinds, '') AS kinds, coalesce(n, 0) AS n
FROM events JOIN frame ON frame.k = event_id % 8 LEFT JOIN one ON one.k = frame.k
""")
def redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = privacy.protect(_said(spark, sf_dir, PERSONAL), "text")
    return rows.select("event_id", F.col("text").alias("redacted"), "pii", F.array_join("pii_types", ",").alias("kinds"), F.size("pii_findings").cast("long").alias("n"))


@query(PERSONAL_SQL + "SELECT kind, count(*) AS n, count(DISTINCT event_id) AS rows_touched FROM events JOIN token ON k = event_id % 8 GROUP BY kind")
def personal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.counts(privacy.protect(_said(spark, sf_dir, PERSONAL), "text"))


@query(PERSONAL_SQL + """,
wanted AS (SELECT event_id, k, kind, token.value FROM events JOIN token ON k = event_id % 8 WHERE kind <> 'DOB'),
n AS (SELECT kind, count(DISTINCT (event_id, value)) AS expected FROM wanted GROUP BY kind)
SELECT kind, expected, expected AS caught, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS coverage, 0 AS spurious FROM n
UNION ALL SELECT 'DOB', 0, 0, 1.0, 0.0, (SELECT count(*) FROM events WHERE event_id % 8 IN (1, 7))
UNION ALL SELECT 'NAME', (SELECT count(*) FROM events WHERE event_id % 8 = 4), 0, 0.0, 0.0, 0
""")
def personal_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against what is expected: all kinds but dates of birth, and a name that no text holds."""
    rows = privacy.protect(_said(spark, sf_dir, PERSONAL).withColumn("raw", F.col("text")), "text")
    found = rows.select(F.col("event_id").alias("row"), F.explode("pii_findings").alias("f")).select("row", "f.kind", "f.text")
    missing = rows.where(F.col("event_id") % 8 == 4).select(F.col("event_id").alias("row"), F.lit("NAME").alias("kind"), F.lit("Ann Lee").alias("value"))
    expected = found.where("kind <> 'DOB'").select("row", "kind", F.col("text").alias("value")).distinct().unionByName(missing)
    return privacy.score(expected, found)


TURNS = [
    ("I am struggling, no money this month", "ok", False), ("maybe later, my wife decides", "Noted.", False), ("how much is it", "You are approved, I guarantee it", False), ("my son drives", "We can add him too", False),
    ("this is ridiculous, i already told you", "I do not have that.", True), ("bisa diulangi", "ok", False), ("well", "You qualify, subject to underwriting", False)]
SIGNALS_SQL = """
WITH s(k, ord, kind, confidence, evidence) AS (VALUES
  (0, 0, 'hardship', 0.88::DOUBLE, 'no money'), (1, 0, 'soft_refusal', 0.72, 'maybe later'), (1, 1, 'hesitation', 0.72, 'maybe'), (1, 2, 'missed_opportunity', 0.74, 'my wife'),
  (2, 0, 'buying_signal', 0.72, 'how much is it'), (2, 1, 'agent_guarantee', 0.9, 'i guarantee'), (2, 2, 'missing_disclosure', 0.85, 'you are approved'),
  (4, 0, 'frustration', 0.88, 'this is ridiculous'), (4, 1, 'knowledge_gap', 1.0, 'this is ridiculous, i already told you'), (5, 0, 'confusion', 0.72, 'bisa diulangi'))
SELECT user_id AS conv_id, event_id AS turn, ord, kind, confidence, evidence FROM events JOIN s ON k = event_id % 7
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array(*[F.struct(F.lit(c).alias("caller"), F.lit(a).alias("agent"), F.lit(r).alias("agent_refused")) for c, a, r in TURNS])
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.element_at(made, (F.col("event_id") % len(TURNS) + 1).cast("int")).alias("t"))
    return rows.select("conv_id", "turn", "t.*")


@query(SIGNALS_SQL)
def turn_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nudges.exploded(signals.lexical(_turns(spark, sf_dir)))


READ = [
    "Due 5/3/2024 or March 7, 2024. The premium and the hulog.", "**Bold** and `code`, [link](http://x)\n\n# Head", "A grace period of thirty (30) days applies. The grace period is 31 days.", "thank you.", "yes I do", "I am 35 years old",
    "what is the tenor?", "hello", "punten, magkano po ang premium", "sige po, kayo na. kamu ka po"]
READ_SQL = r"""
WITH r(k, dated, changed, concepts, grace, speech, silence, needs, languages, region, mixed) AS (VALUES
  (0, 'Due 2024-03-05 or 2024-03-07. The premium and the hulog.', 2, 'premium', '', 'Due 5/3/2024 or March 7, 2024. The premium and the hulog.', false, true, 'english,tagalog', 'standard', false),
  (1, '**Bold** and `code`, [link](http://x)' || chr(10) || chr(10) || '# Head', 0, '', '', 'Bold and code, link' || chr(10) || 'Head', false, true, 'english', 'standard', false),
  (2, 'A grace period of thirty (30) days applies. The grace period is 31 days.', 0, 'grace_period', '30,31', 'A grace period of thirty (30) days applies. The grace period is 31 days.', false, true, 'english', 'standard', false),
  (3, 'thank you.', 0, '', '', 'thank you.', true, true, 'english', 'standard', false), (4, 'yes I do', 0, '', '', 'yes I do', false, false, '', 'standard', false), (5, 'I am 35 years old', 0, '', '', 'I am 35 years old', false, false, '', 'standard', false),
  (6, 'what is the tenor?', 0, 'tenor', '', 'what is the tenor?', false, true, 'english,indonesian', 'standard', false), (7, 'hello', 0, '', '', 'hello', false, false, '', 'standard', false),
  (8, 'punten, magkano po ang premium', 0, 'premium', '', 'punten, magkano po ang premium', false, true, 'tagalog,english', 'sunda', false),
  (9, 'sige po, kayo na. kamu ka po', 0, '', '', 'sige po, kayo na. kamu ka po', false, true, 'tagalog,indonesian', 'standard', true))
SELECT event_id, dated, changed, concepts, grace, speech, silence, needs, languages, region, mixed FROM events JOIN r ON k = event_id % 10
"""


@query(READ_SQL)
def text_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text: Column = F.col("text")
    dates = X.normalise_dates(text)
    return _said(spark, sf_dir, READ).select(
        "event_id", dates["text"].alias("dated"), dates["changed"].alias("changed"), F.array_join(X.terminology(text)["concepts"], ",").alias("concepts"),
        F.array_join(F.transform(X.claimed_durations(text, vocab.TOPICS["grace_period"]), lambda c: c["days"].cast("string")), ",").alias("grace"), X.for_speech(text).alias("speech"), speech.is_silence(text).alias("silence"),
        conversation.needs_knowledge(text).alias("needs"), F.array_join(speech.code_switch(text)["languages"], ",").alias("languages"), speech.region(text, {"sunda": ["punten"], "jawa": ["nggih"]}).alias("region"),
        speech.register(text)["mixed"].alias("mixed"))


CLAIMS = ["The grace period is 30 days. Pay then.", "A grace period of thirty-one or 31 days applies.", "Grace period: two months.", "Nothing is said of it here, 90 days.", "The grace period is 60 days."]
CONFLICT_SQL = """
WITH claim(k, days, quote) AS (VALUES (0, 30, 'The grace period is 30 days.'), (1, 31, 'A grace period of thirty-one or 31 days applies.'), (2, 60, 'Grace period: two months.'), (4, 60, 'The grace period is 60 days.')),
r AS (SELECT event_id, 'r' || event_id AS record_id, event_id // 8 AS u, CASE event_id % 3 WHEN 0 THEN 'binding' WHEN 1 THEN 'published' ELSE 'promotional' END AS authority, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS rank, days, quote
      FROM events JOIN claim ON k = event_id % 5 WHERE event_id % 11 <> 0),
p AS (SELECT l.*, r.record_id AS r_id, r.days AS r_days, r.quote AS r_quote, r.authority AS r_authority, r.rank < l.rank AS right_wins FROM r l JOIN r ON l.u = r.u AND l.event_id < r.event_id AND abs(l.days - r.days)::DOUBLE / greatest(l.days, r.days) > 0.1)
SELECT 'grace_period' AS topic, 'u' || u AS business_unit, record_id || ',' || r_id AS records, days || ' days (' || authority || ');' || r_days || ' days (' || r_authority || ')' AS claims, quote || '|' || r_quote AS quotes,
       CASE WHEN authority <> r_authority THEN 'authority' ELSE 'unresolved' END AS resolved_by, CASE WHEN right_wins THEN r_id ELSE record_id END AS authoritative, CASE WHEN right_wins THEN record_id ELSE r_id END AS superseded,
       'contradicts_' || CASE WHEN right_wins THEN r_authority ELSE authority END || '_source' AS flag FROM p
"""


@query(CONFLICT_SQL)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records, eight to a unit; every eleventh is a duplicate."""
    at = F.col("event_id")
    authority = F.when(at % 3 == 0, F.lit("binding")).when(at % 3 == 1, F.lit("published")).otherwise(F.lit("promotional"))
    rows = _said(spark, sf_dir, CLAIMS, "content").select(
        F.concat(F.lit("r"), at.cast("string")).alias("record_id"), at.alias("ord"), F.concat(F.lit("u"), F.floor(at / 8).cast("string")).alias("business_unit"), authority.alias("authority"),
        F.when(at % 11 == 0, F.lit("r0")).otherwise(F.lit("")).alias("duplicate_of"), "content")
    found = clean.conflicts(rows)
    return found.select("topic", "business_unit", F.array_join("records", ",").alias("records"), F.array_join("claims", ";").alias("claims"), F.array_join("quotes", "|").alias("quotes"), "resolved_by", "authoritative", "superseded", "flag")


#: What each page's words come to: four lines, the words of the table's box left out.
LAYOUT_SQL = """
WITH p AS (SELECT user_id AS doc_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, count(*) OVER (PARTITION BY user_id) AS n FROM events),
h AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'Loadings' WHEN event_id % 4 = 1 THEN 'and more' ELSE 'Section ' || page || ': Terms' END AS line, CASE WHEN event_id % 4 = 0 THEN 'Loadings' WHEN event_id % 4 = 1 THEN '' ELSE 'Section ' || page || ' Terms' END AS heading FROM p)
SELECT doc_id, page, 0 AS line_no, 'Policy Guide' AS text, n >= 2 AS furniture, heading FROM h
UNION ALL SELECT doc_id, page, 1, line, false, heading FROM h
UNION ALL SELECT doc_id, page, 2, 'text ' || event_id || ' here.', false, heading FROM h
UNION ALL SELECT doc_id, page, 3, 'page ' || page, true, heading FROM h
"""


@query(LAYOUT_SQL)
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of their user's document: positioned words to lines, furniture, and the heading of a table."""
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    pages = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), page.alias("page"), "event_id")
    at, no = F.col("event_id"), F.col("page").cast("string")
    title = F.when(at % 4 == 0, F.array(F.lit("Loadings"))).when(at % 4 == 1, F.array(F.lit("and"), F.lit("more"))).otherwise(F.array(F.lit("Section"), F.concat(no, F.lit(":")), F.lit("Terms")))

    def word(text: Column, top: float, x: float) -> Column:
        return F.struct(text.alias("text"), F.lit(top).alias("top"), F.lit(top + 10).alias("bottom"), F.lit(x).alias("x0"), F.lit(x + 20).alias("x1"))

    fixed = F.array(
        word(F.lit("Guide"), 10.0, 60.0), word(F.lit("Policy"), 10.0, 5.0), word(F.lit("here."), 132.0, 90.0), word(F.lit("text"), 130.0, 5.0), word(at.cast("string"), 131.5, 40.0), word(F.lit("cell"), 215.0, 50.0),
        word(F.lit("page"), 960.0, 5.0), word(no, 960.0, 50.0))
    titled = F.transform(title, lambda t, i: F.struct(t.alias("text"), F.lit(100.0).alias("top"), F.lit(110.0).alias("bottom"), (5.0 + i * 40).alias("x0"), (25.0 + i * 40).alias("x1")))
    words = pages.select("doc_id", "page", F.explode(F.concat(fixed, titled)).alias("w")).select("doc_id", "page", "w.*")
    boxes = pages.select("doc_id", "page", F.lit(0.0).alias("left"), F.lit(500.0).alias("right"), F.lit(200.0).alias("upper"), F.lit(260.0).alias("lower"))
    rows = layout.mark_furniture(layout.lines(layout.outside_tables(words, boxes)), pages.select("doc_id", "page", F.lit(1000.0).alias("height")))
    above = layout.headings_above(pages.select("doc_id", "page", F.lit(200.0).alias("top")), rows).select("doc_id", "page", "heading")
    return rows.join(above, ["doc_id", "page"]).select("doc_id", "page", "line_no", "text", "furniture", "heading")
