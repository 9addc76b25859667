"""Registered queries of this package and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.llm import (
    attention_lm, bpe_tree, inner_top_k, jaccard_join, line_crf, line_dedup, mixing, paragraph_dedup, plane_files, quality_bands,
    token_alignment, token_counts, whitening,
)
from tillview.llm.common import stored, table
from tillview.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_edit_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = token_counts.private_edits(table(spark, folder, "documents").select("doc_id", "text"))
    counted = token_counts.edit_token_counts(docs)
    return counted.select(
        "doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_encoded", F.sha2("edited", 256).alias("edited_sha256")
    )


@query
def op5_bpe_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe_tree.bpe_encode(docs, packed=True, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_quality_bands(spark: SparkSession, folder: str) -> DataFrame:
    docs = quality_bands.quality_bands(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.drop("text")


@query
def op10_plane_files(spark: SparkSession, folder: str) -> DataFrame:
    target = new_folder(spark, "planes")
    plane_files.write_plane_files(table(spark, folder, "documents"), target)
    read = plane_files.read_plane_files(spark, target)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op2_multi_order_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))


@query
def op4_paragraph_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(table(spark, folder, "documents"))


@query
def op3_simhash_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op6_norm_sorted_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = stored(inner_top_k.quantised(table(spark, folder, "embeddings")), "quantised")
    return inner_top_k.top_inner_products(vectors.where("vec_id % 20 = 0"), vectors)


ORACLES["op6_norm_sorted_top_k"] = """
WITH valid AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
),
parts AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding) AS x FROM valid
),
bad AS (SELECT DISTINCT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)),
whole AS (
  SELECT vec_id, k, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM parts
  WHERE vec_id NOT IN (SELECT vec_id FROM bad)
),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.k = c.k AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
  GROUP BY q.vec_id, c.vec_id
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op8_attention_lm(spark: SparkSession, folder: str) -> DataFrame:
    return attention_lm.score_documents(table(spark, folder, "documents"))


@query
def op11_qdwh_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    axes = white.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")))
    return axes.select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", F.col("col.whitened").alias("whitened"),
        F.col("col.explained").alias("explained"), "identity_error",
    )


@query
def op12_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = line_crf.document_quality(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_lines")


@query
def op13_anchor_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = token_alignment.align_tokens(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    aligned = stored(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    scored = token_alignment.link_scores(aligned, stored(token_alignment.pair_counts(aligned), "counts"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
