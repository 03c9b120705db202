"""Toxicity of texts by a linear classifier on scaled character n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodeseek.llm.nbsvm import Grams, Model, scored, train

TOXIC = Grams(sizes=(4, 5), folded=True, bits=20)


def toxicity_model(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    per_class: int = 2500,
) -> Model:
    """See ``nbsvm.train``; label 1 is toxic."""
    return train(docs, labels, label_col, TOXIC, id_col, text_col, per_class)


def toxicity_scores(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, score_col: str = "score",
    predicted_col: str = "predicted",
) -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1, higher is more toxic) and ``predicted_col`` (1 from ``threshold`` on).

    Null and empty texts get the score of a text without features. Columns of these names are
    replaced; every row stays, repeated ones too.
    """
    rows = docs.withColumn(score_col, scored(docs, model, text_col))
    return rows.withColumn(predicted_col, (rows[score_col] >= threshold).cast("int"))
