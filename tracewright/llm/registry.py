"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, embeddings, language, licences, media, mixing, nearest, pii, quality, resampling, simhash, toxicity
from .common import fold, read_table

#: The vocabulary file of the token queries; it must lie at this path on every executor.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _judged(scored: DataFrame, held) -> DataFrame:
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold("doc_id", 3) != 1)
    return _judged(quality.score(docs.select("doc_id", "text"), model).drop("text"), F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, VOCABULARY, with_ids=False).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), radius=4, shingle=4)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    return _judged(toxicity.score(docs.select("doc_id", "text"), machine).drop("text"), F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = media.store(read_table(spark, sf_dir, "documents"))
    return media.features(media.load(spark, folder), strict=True)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.98)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_row(pii.sanitised(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=64)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), seed=7, percent=25, least_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest_row(*codes.compress(read_table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import stages

    return stages.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_media": op6_media,
    "op7_toxicity": op7_toxicity,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_topk_search": op11_topk_search,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op2_license_scan": licences.oracle(),
    "op11_topk_search": nearest.oracle(),
    "op12_importance_resampling": resampling.oracle(),
    "op13_vector_codes": codes.oracle(),
}
