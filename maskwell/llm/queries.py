"""The operators as queries over whole tables. Each takes a session and a folder of tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import (
    ann,
    centroids,
    exact_dedup,
    html_extract,
    language_id,
    line_dedup,
    mixing,
    pitman_yor,
    prob_minhash,
    segmentation,
    simhash,
    spelling,
    toxicity,
)
from maskwell.llm.common import fold, stage

#: Place of the public SentencePiece model; the same file is needed on the driver only.
MODEL_FILE = os.environ.get("MASKWELL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
TOXIC_FROM = 0.7
#: Segmentations of a text that are searched for.
N_BEST = 3


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def toxicity_model(spark: SparkSession, folder: str, docs: DataFrame | None = None) -> toxicity.Model:
    """Fitted on labelled rows outside the held-out fold."""
    docs = _table(spark, folder, "documents") if docs is None else docs
    docs = docs.select("doc_id", "text").filter(fold(F.col("doc_id"), 3) != 1)
    labels = _table(spark, folder, "labels").select("doc_id", "toxic")
    return toxicity.fit(docs.join(labels, "doc_id"))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    model = toxicity_model(spark, folder)
    docs = _table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        toxicity.score(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = prob_minhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "class_size", "links", "kept")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("position", "slot", "epoch", "source", "doc_id")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs.filter(~held_out))
    found = language_id.predicted(F.col("text"), model)
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("found")).select(
        "doc_id",
        "held_out",
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.rejected").alias("rejected"),
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, folder, "documents"))


def op6_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages)


def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows = stage(ann.usable(_table(spark, folder, "embeddings"), "vec_id", "embedding"))
    return ann.search(rows, rows.filter(F.col("vec_id") % 20 == 0), ann.fit(rows), k=20)


def op8_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return pitman_yor.score(docs, fold(F.col("doc_id"), 10) == 0)


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Number of pieces, scores and id hashes of the three best segmentations, and the round trip."""
    vocabulary = segmentation.read_vocabulary(MODEL_FILE)
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    done = segmentation.encode(docs, vocabulary, n=N_BEST)
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.get("scores", F.lit(0)).alias("score"),
        F.col("scores").alias("n_best_scores"),
        F.xxhash64("ids").alias("ids_hash"),
        F.transform("n_best", lambda ids: F.xxhash64(ids)).alias("n_best_hashes"),
        (segmentation.decoded(F.col("ids"), vocabulary) == F.coalesce("text", F.lit(""))).alias(
            "round_trip"
        ),
    )


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    done = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = stage(spelling.vocabulary(_table(spark, folder, "documents")))
    return spelling.variants(words)


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(_table(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_toxicity,
        op2_near_dedup,
        op3_mixing,
        op4_language_id,
        op5_exact_dedup,
        op6_html_extract,
        op7_nearest,
        op8_lm_score,
        op9_pieces,
        op10_line_dedup,
        op11_spelling,
        op12_simhash,
        op13_centroids,
        pipeline,
    )
    return {f.__name__: f for f in named}
