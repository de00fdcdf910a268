"""Stages of the pipeline with other columns of odd and clashing names, and tables without rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholia.llm import language_id

ODD = ("__scholia_prediction", "__scholia_prediction_rejected", "a.b", "node", "key", "Gone", "sp score", "lang_pred", "class_id", "n_lines")
STAGES = {name: stage for name, stage in corpus_pipeline.STAGES if name != "piece_segmentation"}


@pytest.mark.parametrize("name", STAGES)
def test_stage_passes_columns(spark, documents, folder, name):
    words = "the quick brown fox jumps over a lazy dog while seven wizards brew strong potions".split()
    rows = [(i, " ".join(words[(i * j) % len(words)] for j in range(1, 40)), "en") for i in range(1, 9)] + [(20, None), (21, ""), (None, "no id here")]
    docs = documents(rows)
    for i, c in enumerate(ODD):
        docs = docs.withColumn(c, F.col("doc_id") * 10 + i)
    d = folder(benchmark=spark.createDataFrame([(1, "nothing of the kind stands in any of these texts at all")], "item_id long, text string"))
    out = STAGES[name](spark, docs, d)
    assert out.columns == docs.columns
    for r in out.where("doc_id is not null").collect():
        assert [r[c] for c in ODD] == [r["doc_id"] * 10 + i for i in range(len(ODD))]


def test_pipeline_of_no_rows(spark, documents, folder):
    d = folder(documents=documents([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, d).collect() == []


def test_learning_from_a_repeated_text(spark, documents):
    """A text repeated many times counts once, and the model doesn't depend on partitions."""
    rows = [(i, f"some english words number {i} about weather and food", "en") for i in range(80)] + [(100 + i, f"ein paar deutsche Wörter Nummer {i} über Wetter und Essen", "de") for i in range(80)]
    once, many = language_id.fit(documents(rows)), language_id.fit(documents(rows).repartition(7))
    assert (once.centres == many.centres).all() and (once.floors == many.floors).all()
    repeated = documents(rows + [(900 + i, "copy of one text", "en") for i in range(3000)])
    assert len(language_id.fit(repeated).centres) == len(once.centres)
