"""The whole pipeline on planted rows, and floors for what is learned."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

from maskwell.llm import queries, segmentation

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")

LINE = "This very line stands in several of the documents."


def planted():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    text = lambda: " ".join(rng.choices(words, k=300))
    rows = []
    base = text().split()
    for k in range(6):  # near copies, two of them exact
        edit = list(base)
        for at in rng.sample(range(300), 2 if k > 1 else 0):
            edit[at] = f"edit{k}"
        rows.append((9000 + k, " ".join(edit)))
    rows += [(9100 + k, f"{text()}\n{LINE}\n{text()}") for k in range(4)]  # a shared line
    rows += [(9200 + k, text()) for k in range(5)]  # nothing in common
    rows += [(9300, None), (9301, ""), (9302, "  ")]
    return rows


def test_run_on_planted_rows(spark, tmp_path):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = planted()
    given = dict(rows)
    more = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text", F.lit("en").alias("lang"),
        F.lit("planted").alias("source"),
        F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"),
    )
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    done = corpus_pipeline.run(spark, str(tmp_path)).filter("doc_id >= 9000")
    vocabulary = segmentation.read_vocabulary(queries.MODEL_FILE)
    got = {}
    for r in done.select("doc_id", segmentation.decoded(F.col("ids"), vocabulary).alias("text")).collect():
        assert got.setdefault(r.doc_id, r.text) == r.text
    # All three best segmentations are searched for, in every text of more than one.
    best = done.select("score", "n_best_scores").filter("n_pieces > 100").collect()
    assert best and all(len(r.n_best_scores) == 3 and r.n_best_scores[0] == r.score for r in best)
    assert len([i for i in got if i < 9100]) == 1
    assert [i for i in sorted(got) if 9100 <= i < 9300] == [*range(9100, 9104), *range(9200, 9205)]
    for i in range(9100, 9104):
        want = given[i] if i == 9103 else given[i].replace(f"\n{LINE}", "")
        assert got[i] == want
    assert all(got[i] == given[i] for i in range(9200, 9205))
    assert len([i for i in got if i >= 9300]) == 1  # empty texts are one group


def test_toxic_recall_has_a_floor(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op1_toxicity(spark, folder).filter("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = rows[rows["toxic"] == 1], rows[rows["toxic"] == 0]
    # About half of the rows labelled toxic here hold nothing that is; 0.51 and 0.995 were seen.
    assert len(toxic) and (toxic["predicted"] == 1).mean() > 0.45
    assert (clean["predicted"] == 0).mean() > 0.98
