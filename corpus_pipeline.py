"""A cleaning pipeline over ``documents``: stages that each read what the one before wrote.

The stages take any table with the columns of ``documents``: texts that are null or empty, repeated rows
and empty tables pass as the operators' docstrings say; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.line_dedup import line_dedup
from lodeseek.llm.nbsvm import held_out, scored
from lodeseek.llm.ngram_join import ngram_jaccard_join
from lodeseek.llm.packing import pack, token_pieces
from lodeseek.llm.quality import quality_model
from lodeseek.llm.staging import staged
from lodeseek.llm.substring_dedup import substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
KEEP_FROM = 0.3  # quality score


def _like(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``docs`` and the length of the text as it now is."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, scores ``KEEP_FROM`` or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    model = quality_model(docs, labels)
    return docs.where(scored(docs, model) >= KEEP_FROM).select(docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that more than a tenth of their source's distinct texts have; copies are left to later stages."""
    return _like(line_dedup(docs, "source", "text", max_ratio=0.1), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates; rows without an id stay."""
    groups = ngram_jaccard_join(docs, width=5, percent=80)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of twenty words or more that start earlier."""
    return _like(substring_dedup(docs, "doc_id", "text", window=20), docs)


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the texts and their places in sequences of 1024 tokens."""
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), max_tokens=1024, with_ids=False)
    return pack(pieces, 1024).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_filter", quality_filter),
    ("drop_boilerplate_lines", drop_boilerplate_lines),
    ("drop_near_copies", drop_near_copies),
    ("drop_repeated_passages", drop_repeated_passages),
    ("packed_pieces", packed_pieces),
]
ORACLE_SQL = None  # a fitted classifier and a tokenizer can't be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = staged(docs)
    return docs
