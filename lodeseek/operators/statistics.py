"""Statistics over all matching documents.

Every figure comes from counts per value that are aggregated map-side first, so a value shared
by a third of all documents is one small row per task. Character and line counts are bounded by
``max_file_size``, which keeps the exact percentiles cheap at any number of documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.operators.filters import COMMIT, FILE
from lodeseek.schemas import REPO_KEY
from lodeseek.settings import PERCENTILES, PRECISION_THRESHOLD, RANKING_SIZE

# A sketch of 2^13 registers: a standard error of 0.9 percent.
SKETCH_BITS = 13


def distinct_values(matches: DataFrame, column: str, approximate: bool = False, rsd: float = 0.01) -> DataFrame:
    """Number of distinct values; exact unless asked otherwise."""
    if approximate:
        return matches.agg(F.approx_count_distinct(column, rsd).alias("cardinality"))
    return matches.select(column).filter(F.col(column).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("cardinality"))


def cardinality_parts(
    matches: DataFrame, column: str, by: Sequence[str] = REPO_KEY, threshold: int = PRECISION_THRESHOLD,
) -> DataFrame:
    """``(*by, values, sketch)``: distinct counts of each group that can be stored and added up by ``merged_cardinality``.

    ``values`` are the distinct values of a group that has at most ``threshold``, null beyond. Each task keeps its
    own first ``threshold`` + 1 values of a group before the shuffle, and sketches are merged map-side, so a group that
    holds a third of all rows meets nowhere whole. Null values are not counted; a group with no others has no row.
    """
    value = F.col(column).cast("string")
    rows = matches.filter(value.isNotNull()).select(*by, value.alias("value")).distinct()
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("value")))
    first = first.filter(F.col("place") <= threshold + 1).groupBy(*by).agg(F.collect_list("value").alias("values"))
    sketches = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.hll_sketch_agg("value", F.lit(SKETCH_BITS)).alias("sketch"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    few = F.when(F.size("values") <= threshold, F.array_sort("values")).alias("values")
    return first.join(sketches, same).select(*by, few, "sketch")


def merged_cardinality(parts: DataFrame, threshold: int = PRECISION_THRESHOLD) -> DataFrame:
    """Number of distinct values over stored parts: exact up to ``threshold``, an estimate of the merged sketches beyond."""
    listed = parts.select(F.explode("values").alias("value")).distinct().limit(threshold + 1)
    exact = listed.agg(F.count(F.lit(1)).alias("n")).scalar()
    merged = parts.agg(
        F.coalesce(F.bool_and(F.col("values").isNotNull()), F.lit(True)).alias("few"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    return merged.select(F.when(F.col("few") & (exact <= threshold), exact).otherwise(F.col("estimate")).alias("cardinality"))


def counts(matches: DataFrame, column: str) -> DataFrame:
    return matches.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(
        F.count(F.lit(1)).alias("count")
    )


def top(per_key: DataFrame, size: int = RANKING_SIZE) -> DataFrame:
    return per_key.orderBy(F.desc("count"), "key").limit(size)


def ranking(per_key: DataFrame, size: int = RANKING_SIZE) -> DataFrame:
    """The most frequent keys with their share, and a row for all the others together."""
    total = per_key.agg(F.sum("count").alias("total")).scalar()
    best = top(per_key, size)
    shown = best.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("shown"))
    named = best.select("key", "count", F.lit(False).alias("other"))
    rest = shown.select(F.lit("Other").alias("key"), (total - F.col("shown")).alias("count"), F.lit(True).alias("other"))
    both = named.unionByName(rest.filter(F.col("count") > 0))
    return both.withColumn("proportion", F.col("count") / total)


def percentiles(matches: DataFrame, column: str, wanted: Sequence[float] = PERCENTILES, approximate: bool = False) -> DataFrame:
    """Rows of (percentile, value), interpolated exactly unless asked otherwise."""
    shares = [p / 100 for p in wanted]
    if approximate:
        row = matches.agg(F.percentile_approx(column, shares, 10_000).alias("value"))
    else:
        per_value = matches.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        row = per_value.agg(F.percentile(column, shares, F.col("n")).alias("value"))
    return percentile_rows(row, wanted)


def percentile_rows(row: DataFrame, wanted: Sequence[float] = PERCENTILES) -> DataFrame:
    labels = F.array(*[F.lit(float(p)) for p in wanted])
    return row.select(F.explode(F.arrays_zip(labels.alias("percentile"), F.col("value")))).select("col.*")


def extended_stats(matches: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return matches.agg(
        F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"),
        F.sum(x).alias("sum"), F.sum(x.cast("double") * x).alias("sum_of_squares"),
        F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std_deviation"),
    )


def type_counts(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.count_if(F.col("doc_type") == COMMIT).alias("commitcount"),
        F.count_if(F.col("doc_type") == FILE).alias("filecount"),
    )


def total_hits(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("total_hits"))


RANKED = {"authoremail": "author", "extension": "extension"}
MEASURED = ("charcount", "linecount")


def facet_counts(matches: DataFrame) -> DataFrame:
    """(facet, key, count) for each value of each facet, from one scan of the matches."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("key")) for f in (*RANKED, *MEASURED)])
    rows = matches.select(F.explode(pairs).alias("pair")).select("pair.*").filter("key is not null")
    # The facet comes out as an aggregate, so a filter on it stays above the shuffle and all
    # readers of this frame share that one shuffle.
    counted = rows.groupBy("facet", "key").agg(F.max("facet").alias("name"), F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("name").alias("facet"), "key", "count")


def statistics(matches: DataFrame) -> DataFrame:
    """The whole block as rows of (section, key, value).

    ``matches`` has authoremail (commits), extension, charcount and linecount (files).
    """
    counted = facet_counts(matches)
    value, facet = F.col("key").try_cast("bigint"), F.col("facet")
    measured = F.when(facet.isin(*MEASURED), value)
    summary = counted.groupBy("facet").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("count").alias("n"), F.min(measured).alias("low"),
        F.max(measured).alias("high"), F.sum(measured * F.col("count")).alias("total"),
        F.percentile(measured, [p / 100 for p in PERCENTILES], F.col("count")).alias("shares"),
    )
    best = Window.partitionBy("facet").orderBy(F.desc("count"), "key")
    # Each task keeps its own first rows before the shuffle, so no facet meets in one task whole.
    top_rows = counted.withColumn("place", F.row_number().over(best)).filter(
        (F.col("place") <= RANKING_SIZE) & facet.isin(*RANKED)
    ).select("facet", "key", "count")
    section = F.concat(F.create_map(*[F.lit(x) for pair in RANKED.items() for x in pair])[facet], F.lit("Ranking"))
    shown = top_rows.groupBy("facet").agg(F.sum("count").alias("shown"))
    other = shown.join(summary.select("facet", "n"), "facet").select(
        "facet", F.lit("Other").alias("key"), (F.col("n") - F.col("shown")).alias("count")).filter("count > 0")
    ranked = top_rows.unionByName(other).select(section.alias("section"), "key", F.col("count").cast("double").alias("value"))
    return _summary_rows(summary).unionByName(ranked)


def _summary_rows(summary: DataFrame) -> DataFrame:
    def rows(**values: Column) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in values.items()])

    def block(section: str, pairs: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), pairs.alias("rows"))

    # A facet without any value has no row yet; it counts as zero.
    names = F.array(*[F.lit(f) for f in (*RANKED, *MEASURED)])
    every = summary.agg(F.map_from_entries(F.collect_list(F.struct("facet", F.struct("keys", "n", "low", "high", "total", "shares")))).alias("m"))
    every = every.select(F.explode(names).alias("facet"), "m").select("facet", F.col("m")[F.col("facet")].alias("s"))
    n = F.coalesce(F.col("s.n"), F.lit(0))
    figures = rows(
        count=n, sum=F.col("s.total"), min=F.col("s.low"), max=F.col("s.high"),
        average=F.round(F.col("s.total") / F.col("s.n"), 6),
        **{f"p{p:g}": F.round(F.col("s.shares")[i], 6) for i, p in enumerate(PERCENTILES)},
    )
    blocks = F.when(F.col("facet") == "charcount", F.array(block("charcount", figures), block("filecount", rows(value=n))))
    blocks = blocks.when(F.col("facet") == "linecount", F.array(block("linecount", figures)))
    for facet, name in RANKED.items():
        own = [block(f"{name}Cardinality", rows(value=F.coalesce(F.col("s.keys"), F.lit(0))))]
        own += [block("commitcount", rows(value=n))] if facet == "authoremail" else []
        blocks = blocks.when(F.col("facet") == facet, F.array(*own))
    exploded = every.select(F.explode(blocks).alias("b")).select("b.section", F.explode("b.rows").alias("r"))
    return exploded.select("section", "r.key", "r.value")
