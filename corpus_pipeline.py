"""A corpus from raw documents to token ids, in five stages.

Every stage reads what the one before it has written and works on all of it. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import line_dedup, mixing, prob_minhash, segmentation, toxicity
from maskwell.llm.common import fresh, stage
from maskwell.llm.queries import MODEL_FILE, N_BEST, TOXIC_FROM, toxicity_model


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model is fitted on labels."""
    model = toxicity_model(spark, sf_dir, docs)
    score = fresh(docs, "score")
    scored = docs.withColumn(score, toxicity.score(F.col("text"), model))
    return scored.filter(F.col(score) < TOXIC_FROM).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; ``n_chars`` follows the text."""
    done = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs)).select(*docs.columns)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return prob_minhash.keep_one(docs, prob_minhash.near_duplicates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix; a small source comes again in later epochs."""
    return mixing.apply(docs, mixing.mix(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the best segmentation and the scores of the three best."""
    vocabulary = segmentation.read_vocabulary(MODEL_FILE)
    done = segmentation.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, n=N_BEST)
    return done.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.get("scores", F.lit(0)).alias("score"),
        F.col("scores").alias("n_best_scores"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Compression with a trained dictionary has no SQL form. The tests hold operators against
#: plain versions, and ``run`` against what is planted in its documents: copies, shared lines,
#: empty texts and rows that must stay as they are.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
