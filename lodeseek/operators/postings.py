"""Token tables for corpora that are searched often.

``postings`` has one row per token occurrence. Stored by field and term bucket, a search reads
only its own terms. All groupings include the document, so a word that is in every document is
spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.columns import any_of
from lodeseek.functions.text import surface_tokens
from lodeseek.operators.match import Field

TERM_BUCKETS = 256


def postings(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """(field, term, doc_id, pos), positions from 0."""
    per_field = [
        df.select(F.lit(f.name).alias("field"), "doc_id", F.posexplode(surface_tokens(f.name, f.analyzer)).alias("pos", "term"))
        for f in fields
    ]
    rows = reduce(DataFrame.unionByName, per_field)
    return rows.select("field", F.lower("term").alias("term"), "doc_id", "pos")


def vocabulary(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """(field, term, df): in how many documents a field has the term."""
    words = F.array(*[
        F.struct(F.lit(f.name).alias("field"), F.array_distinct(f.tokens).alias("terms")) for f in fields
    ])
    per_field = df.select(F.explode(words).alias("w")).select("w.field", F.explode("w.terms").alias("term"))
    return per_field.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_lengths(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """(doc_id, field, length) in tokens."""
    sizes = F.array(*[F.struct(F.lit(f.name).alias("field"), f.length().alias("length")) for f in fields])
    return df.select("doc_id", F.explode(sizes).alias("s")).select("doc_id", "s.*")


def term_bucket(term: Column | str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def write_postings(rows: DataFrame, folder: str) -> None:
    """Stored by field and term bucket; the hint splits the bucket of a word that is everywhere."""
    keyed = rows.withColumn("term_bucket", term_bucket()).hint("rebalance", "field", "term_bucket")
    ordered = keyed.sortWithinPartitions("field", "term_bucket", "term", "doc_id")
    ordered.write.mode("errorifexists").partitionBy("field", "term_bucket").parquet(folder)


def lookup(rows: DataFrame, terms: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Occurrences of some terms; on a stored table only their buckets are read."""
    wanted = list(dict.fromkeys(terms))
    found = rows.filter(F.col("term").isin(wanted))
    if "term_bucket" in rows.columns:
        found = found.filter(F.col("term_bucket").isin(*[term_bucket(F.lit(t)) for t in wanted]))
    return found.filter(F.col("field").isin(list(fields))) if fields else found


def documents_with_all(rows: DataFrame, terms: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Documents where each term occurs in any of the fields."""
    wanted = list(dict.fromkeys(terms))
    # The set of a document is no larger than the words asked for.
    seen = lookup(rows, wanted, fields).groupBy("doc_id").agg(F.size(F.collect_set("term")).alias("seen"))
    return seen.filter(F.col("seen") == len(wanted)).select("doc_id")


def phrase_starts(rows: DataFrame, run: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, field, start) of every place where the terms follow one another.

    Each occurrence votes for the start it implies; a start with a vote from every slot is a
    hit. This is one aggregation, and no pair of occurrences is ever formed.
    """
    found = lookup(rows, run, fields)
    slots = [F.when(F.col("term") == t, F.lit(i)) for i, t in enumerate(run)]
    votes = found.select("doc_id", "field", "pos", F.explode(F.array_compact(F.array(*slots))).alias("slot"))
    start = (F.col("pos") - F.col("slot")).alias("start")
    starts = votes.groupBy("doc_id", "field", start).agg(F.size(F.collect_set("slot")).alias("seen"))
    return starts.filter(F.col("seen") == len(run)).drop("seen")


def expand(words: DataFrame, test: Column, fields: Sequence[str]) -> DataFrame:
    """Vocabulary rows that a pattern stands for."""
    return words.filter(any_of(F.col("field") == f for f in fields) & test)


def documents_of_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Documents with any of the expanded terms.

    Spark broadcasts the terms while they are few; a pattern that stands for very many is
    shuffled, where adaptive execution splits the occurrences of a common one.
    """
    return rows.join(terms.select("field", "term"), ["field", "term"], "left_semi").select("doc_id").distinct()
