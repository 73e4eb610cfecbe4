"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, host_consensus, impact_search, neighbours, pack, privacy, resample, sketch_dedup, substring_dedup,
    token_alignment, token_counts, url_lists, warc,
)

#: Vocabularies of the token queries; a parameter of their operators.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_linear_grouping_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"))


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.evaluate(url_lists.captures_of(pages), url_lists.changes_of(pages))


def op6_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_consensus.main_text(table(spark, sf_dir, "pages"))


def op9_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = neighbours.toxicity(table(spark, sf_dir, "documents"), neighbours.learnable(table(spark, sf_dir, "labels")))
    held = (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out")
    return scored.select("doc_id", held, "score", "predicted", "neighbours", "cosines")


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), vocabulary(BYTE_LEVEL), vocabulary(PIECES))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_impact_search": op1_impact_search,
    "op2_spaced_seed_decontamination": op2_spaced_seed_decontamination,
    "op3_linear_grouping_dedup": op3_linear_grouping_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_url_lists": op5_url_lists,
    "op6_sketch_dedup": op6_sketch_dedup,
    "op7_warc_dictionary": op7_warc_dictionary,
    "op8_host_consensus": op8_host_consensus,
    "op9_nearest_toxicity": op9_nearest_toxicity,
    "op10_disclosure": op10_disclosure,
    "op11_token_alignment": op11_token_alignment,
    "op12_target_resampling": op12_target_resampling,
    "op13_token_counts": op13_token_counts,
    "pipeline": pipeline,
}

#: Inner products of whole numbers are exact in SQL too.
_SEARCH = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

ORACLES: dict[str, str] = {
    "op1_impact_search": _SEARCH,
    "op5_url_lists": url_lists.ORACLE,
    "op7_warc_dictionary": warc.ORACLE,
    "op12_target_resampling": resample.ORACLE,
}
