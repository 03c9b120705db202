"""Relevance score and result pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.columns import all_of, any_of
from lodeseek.operators.match import Condition, Field, NumberRange, Phrase

Part = tuple[DataFrame, Sequence[Field]]


def _wanted(condition: Condition, fields: Sequence[Field]) -> list[tuple[Field, str]]:
    pairs = [(f, t) for leaf in condition.leaves() for f in leaf.among(fields) for t in leaf.weighted(f)]
    return list(dict.fromkeys(pairs))


def _name(field: Field, token: str) -> str:
    return f"df {field.name} {token}"


def _column(name: str) -> Column:
    """A column whose name holds query text."""
    return F.col("`" + name.replace("`", "``") + "`")


def term_statistics(parts: Sequence[Part], condition: Condition) -> Column:
    """Struct with the number of documents and the document frequency of every weighted token.

    One aggregate row per part, computed map-side; it enters the plan as a scalar subquery.
    """
    names = [_name(f, t) for _, fields in parts for f, t in _wanted(condition, fields)]
    rows = []
    for df, fields in parts:
        own = {_name(f, t): F.count_if(f.has(t)) for f, t in _wanted(condition, fields)}
        rows.append(df.agg(
            F.count(F.lit(1)).alias("n"),
            *[own.get(name, F.lit(0).cast("bigint")).alias(name) for name in names],
        ))
    total = rows[0]
    for row in rows[1:]:
        total = total.unionByName(row)
    total = total.agg(*[F.sum(_column(c)).alias(c) for c in ["n", *names]])
    return total.select(F.struct(*[_column(c) for c in total.columns]).alias("s")).scalar()


def vocabulary_statistics(vocabulary: DataFrame, documents: int, parts: Sequence[Part], condition: Condition) -> Column:
    """The same struct read from a stored vocabulary: only the query's own terms are read."""
    pairs = list(dict.fromkeys(p for _, fields in parts for p in _wanted(condition, fields)))
    here = any_of((F.col("field") == f.name) & (F.col("term") == t) for f, t in pairs)

    def df_of(f: Field, t: str) -> Column:
        own = F.when((F.col("field") == f.name) & (F.col("term") == t), F.col("df"))
        return F.coalesce(F.sum(own), F.lit(0)).alias(_name(f, t))

    row = vocabulary.filter(here).agg(F.lit(documents).cast("bigint").alias("n"), *[df_of(f, t) for f, t in pairs])
    return row.select(F.struct(*[_column(c) for c in row.columns]).alias("s")).scalar()


def _idf(stats: Column, field: Field, token: str) -> Column:
    return 1 + F.log(stats["n"] / (stats[_name(field, token)] + 1))


class _Measures:
    """Expressions that a score needs, each computed once per row under a name of its own."""

    def __init__(self) -> None:
        self.columns: dict[str, Column] = {}

    def __call__(self, key: str, value: Callable[[], Column]) -> Column:
        if key not in self.columns:
            self.columns[key] = value()
        return _column(key)


def _leaf_in_field(leaf: Condition, field: Field, stats: Column, measure: _Measures) -> tuple[Column, Column]:
    """(weight, matched) of one part of the condition in one field."""
    boost, wanted = field.boost * leaf.boost, list(dict.fromkeys(leaf.weighted(field)))
    if not wanted:
        matched = measure(f"is {leaf!r} {field.name}", lambda: leaf.in_field(field))
        return F.when(matched, boost).otherwise(0.0), matched
    length = measure(f"length {field.name}", field.length)
    if isinstance(leaf, Phrase):
        if leaf.slop:
            tf = measure(f"is {leaf!r} {field.name}", lambda: leaf.in_field(field).cast("int"))
        else:
            tf = measure(f"run {leaf!r} {field.name}", lambda: leaf.frequency(field))
        idf = sum((_idf(stats, field, t) for t in leaf.weighted(field)), F.lit(0.0))
        value, matched = F.sqrt(tf) * idf * idf, tf > 0
    else:
        tfs = {t: measure(f"tf {field.name} {t}", lambda t=t: field.count(t)) for t in wanted}
        value = sum((F.sqrt(tf) * F.pow(_idf(stats, field, t), F.lit(2)) for t, tf in tfs.items()), F.lit(0.0))
        matched = all_of(tf > 0 for tf in tfs.values())
    return F.when(matched, value / F.sqrt(length) * boost).otherwise(0.0), matched


def with_score(df: DataFrame, condition: Condition, fields: Sequence[Field], stats: Column | None) -> DataFrame:
    """Adds ``score``: the sum over the condition's parts of the best field's weight.

    Where parts are optional the sum is scaled by the share of parts that matched.
    """
    leaves = condition.leaves()
    if not leaves or stats is None and any(leaf.weighted(f) for leaf in leaves for f in leaf.among(fields)):
        return df.withColumn("score", F.lit(1.0))
    measure = _Measures()
    total, hits = F.lit(0.0), F.lit(0)
    for leaf in leaves:
        parts = [_leaf_in_field(leaf, f, stats, measure) for f in leaf.among(fields)]
        if isinstance(leaf, NumberRange):
            matched = leaf.test(fields)
            parts = [(F.when(matched, leaf.boost).otherwise(0.0), matched)]
        if not parts:
            continue
        weights = [weight for weight, _ in parts]
        total = total + (F.greatest(*weights) if len(weights) > 1 else weights[0])
        hits = hits + any_of(matched for _, matched in parts).cast("int")
    share = hits / F.lit(float(len(leaves))) if condition.optional else F.lit(1.0)
    measured = df.select(*df.columns, *[value.alias(key) for key, value in measure.columns.items()])
    return measured.select(*df.columns, F.round(total * share, 6).alias("score"))


def page_of(hits: DataFrame, page: int | str | None, page_size: int) -> DataFrame:
    """One page, best score first; equal scores by document id.

    A page that ends beyond 2^31 - 1 results is refused: read on with ``page_after`` instead.
    """
    number = page_number(page)
    if (number + 1) * page_size >= 2**31:
        raise ValueError(f"page {number} of {page_size} results lies beyond 2^31 - 1")
    return hits.orderBy(F.desc("score"), "doc_id").offset(number * page_size).limit(page_size)


def page_after(hits: DataFrame, score: float, doc_id: str, page_size: int) -> DataFrame:
    """The page that follows a hit, in the order of ``page_of``; its cost does not grow with the depth."""
    later = (F.col("score") < score) | ((F.col("score") == score) & (F.col("doc_id") > doc_id))
    return hits.filter(later).orderBy(F.desc("score"), "doc_id").limit(page_size)


def page_number(page: int | str | None) -> int:
    """Anything but a whole number from 0 up means the first page."""
    try:
        number = int(page)
    except (TypeError, ValueError):
        return 0
    return number if 0 <= number < 2**31 else 0


def page_bounds(matches: DataFrame, page: int | str | None, page_size: int) -> DataFrame:
    """Total, number of pages, and the first and last result number of a page."""
    number = page_number(page)
    total = F.col("total_hits")
    return matches.agg(F.count(F.lit(1)).alias("total_hits")).select(
        "total_hits",
        F.ceil(total / page_size).cast("bigint").alias("pages"),
        F.least(total, F.lit(number * page_size + 1).cast("bigint")).alias("result_from"),
        F.least(total, F.lit((number + 1) * page_size).cast("bigint")).alias("result_to"),
    )
