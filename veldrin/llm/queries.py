"""The operators over their whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_output, embedding_dedup, fingerprint, hard_negatives, language_id, line_dedup, minhash, mixing, packing, page_text, secret_scan, spelling, warc
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.report(secret_scan.scan(docs))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC files, these to WARC files, and what reading those back gives."""
    arcs = warc.write_arcs(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    back = warc.resolved(warc.scan_warcs(warc.convert(arcs)))
    number = [F.expr(f"try_cast({c} as long)") for c in ("key", "refers_to")]
    return back.select(number[0].alias("page_id"), "payload_bytes", "payload_digest", "record_type", number[1].alias("refers_to"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per sequence, read back from the matrices in the shared folder: its documents, segment ends, and checksums of
    its id row and its position row."""
    uri = new_path(spark, "matrices")
    index = bin_output.write_indexed(table(spark, sf_dir, "documents").select("doc_id", "text"), uri)
    packed = bin_output.read_matrices(index, uri)
    return packed.select("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the documents whose crc32 remainder is not 0; predicts all."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = language_id.train(docs.where(~held).select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its lines, those that went, and what is left, as a digest."""
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document in training order, with the times at which its first and last copy are trained on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("n_words"))
    return mixing.curriculum(docs, size="n_words").select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives.mine(rows.withColumn("label", hard_negatives.relabelled(F.col("vec_id"), F.col("label"))))


OP13_SQL = """
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM used a JOIN used b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM negatives WHERE rank <= 3
"""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS w, 2 * source_size::DOUBLE AS most FROM sources),
levels AS (
  SELECT *, most / w AS lim,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY most / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed),
goal AS (
  SELECT source, source_size, place, least(most, coalesce((SELECT max(lvl) FROM levels WHERE lvl <= lim) * w, most)) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.place,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
shares AS (
  SELECT *, 2 * c + size <= 2 * target AS in_first, 2 * (c + source_size) + size <= 2 * target AS in_second,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, c::DOUBLE / target) ELSE 0.0::DOUBLE END AS s0,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, (c + source_size)::DOUBLE / target) ELSE 0.0::DOUBLE END AS s1
  FROM placed),
-- where the integral of each source's schedule reaches the share: 1.5 falling to 0.5; steady; 0.5 rising over 1.0 to 1.5
timed AS (
  SELECT *,
         CASE place % 3
           WHEN 0 THEN least(1.0::DOUBLE, 2 * s0 / (1.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2 * s0))))
           WHEN 1 THEN s0
           ELSE CASE WHEN s0 < 0.375::DOUBLE THEN least(0.5::DOUBLE, 2 * s0 / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * s0)))
                ELSE least(1.0::DOUBLE, 0.5::DOUBLE + 2 * (s0 - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 2 * (s0 - 0.375::DOUBLE)))) END
         END AS t0,
         CASE place % 3
           WHEN 0 THEN least(1.0::DOUBLE, 2 * s1 / (1.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2 * s1))))
           WHEN 1 THEN s1
           ELSE CASE WHEN s1 < 0.375::DOUBLE THEN least(0.5::DOUBLE, 2 * s1 / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * s1)))
                ELSE least(1.0::DOUBLE, 0.5::DOUBLE + 2 * (s1 - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 2 * (s1 - 0.375::DOUBLE)))) END
         END AS t1
  FROM shares)
SELECT doc_id, size, source_size, target, (size * (in_first::INT + in_second::INT))::BIGINT AS taken,
       CASE WHEN in_first THEN t0 END AS first_position, CASE WHEN in_second THEN t1 WHEN in_first THEN t0 END AS last_position
FROM timed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_warc": op2_warc,
    "op3_token_output": op3_token_output,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_minhash": op6_minhash,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_fingerprint": op10_fingerprint,
    "op11_html_text": op11_html_text,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = {"op9_mixing": OP9_SQL, "op13_hard_negatives": OP13_SQL}
