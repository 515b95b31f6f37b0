"""The registered query of each operator, over its whole table, and its SQL where SQL can say it.

Each query calls its operator and derives the columns that are compared.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm import exact, histogram, html, language, media, mixing, pieces, quality, simhash, transducer
from tessera.session import small_batches, spread, table


def _remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string")) % of


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    rows = pages.select("page_id", "url", html.extracted(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    rows = histogram.shard_by_bytes(docs, 8)
    return rows.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, limit: int = 512) -> DataFrame:
    small_batches(spark)
    rows = transducer.count_tokens(_texts(spark, sf_dir), path or public_tokenizers.path("byte_bpe_50k.json"))
    rows = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("_n_tokens").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    profiles = language.fit(docs.where(~held))
    rows = _texts(spark, sf_dir).select("doc_id", held.alias("held_out"), language.identify(F.col("text"), profiles).alias("found"))
    return rows.select("doc_id", "held_out", F.col("found.best").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.lang").alias("lang_or_und"), F.col("found.margin").alias("margin"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    docs = docs.withColumn("text_sha256", exact.full_hash(F.col("text")))  # here, so that no text goes on to a join
    return exact.exact_groups(docs).select("doc_id", F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"), F.col("_kept").alias("kept"), "text_sha256")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = _texts(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media.stored(F.col("text")).alias("media"))
    rows = rows.withColumn("read", media.opened(F.col("media")))
    clips = F.array_join(F.transform("read.clips", lambda c: F.concat_ws("-", c["first"], c["end"], F.round(c["level"], 3))), ",")
    feature = F.concat(F.lit("frames="), F.col("read.frames"), F.lit(";fps="), F.col("read.fps"), F.lit(";shots="), clips)
    return rows.select(
        "doc_id", "n_bytes", F.length("read.payload").cast("long").alias("payload_bytes"), F.sha2("read.payload", 256).alias("payload_sha256"), F.crc32(F.substring("read.payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(_remainder(F.col("doc_id"), 5) != 0))
    held = F.coalesce(_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    rows = quality.scored(_texts(spark, sf_dir), model)
    return rows.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.components(_texts(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    small_batches(spark)
    rows = _texts(spark, sf_dir).select("doc_id", pieces.encoded(F.col("text"), path or public_tokenizers.path("piece_bpe_32k.model")).alias("e"))
    return rows.select(
        "doc_id", F.size("e.ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("e.ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("e.decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("e.ends", F.lit(-1)), F.lit(0)).alias("span_bytes"),
    )


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_mixing, op3_sharding, op4_token_counts, op5_language_id, op6_exact_dedup, op7_media_columns, op8_quality, op9_simhash, op10_sentencepiece)}

ORACLE_SQL = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM sums),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS n FROM w),
lv AS (SELECT a.source, a.source_size, a.weight, a.cap, a.n,
              ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce((SELECT sum(b.cap) FROM o b WHERE b.n < a.n), 0)) / ((SELECT sum(weight) FROM w) - coalesce((SELECT sum(b.weight) FROM o b WHERE b.n < a.n), 0)) AS level FROM o a),
hit AS (SELECT min(n) AS n FROM lv WHERE level * weight <= cap),
t AS (SELECT lv.source, source_size, CASE WHEN lv.n >= hit.n THEN least(cap, (SELECT level FROM lv x WHERE x.n = hit.n) * weight) ELSE cap END AS target FROM lv, hit),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((floor(rate) + CASE WHEN ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, d.text_sha256 FROM d JOIN g ON d.text_sha256 = g.text_sha256""",
}
