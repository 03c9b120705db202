"""Removal of boilerplate lines by their frequency within a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.staging import staged

BROADCAST_LINES = 500_000  # numbers of 8 bytes; more are joined by a shuffle


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _counted(line: Column) -> Column:
    return F.trim(line) != ""


def _small(hosts: DataFrame) -> DataFrame:
    held = hosts.agg(F.sum(F.size("lines"))).first()[0] or 0
    return F.broadcast(hosts) if held <= BROADCAST_LINES else hosts


def boilerplate_lines(
    df: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.1, least: int = 2,
    copies: bool = False,
) -> DataFrame:
    """``host`` and ``lines``: hashes of the lines on more than ``max_ratio`` of the host's pages.

    A page is a distinct text of a host; with ``copies`` every row is one. A line counts once for each page;
    blank ones don't count, nor does a line on fewer than ``least`` pages, as it repeats nothing. Rows without a
    host have none. A host has at most its mean number of lines per page / ``max_ratio`` of them.
    """
    pages = df.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    pages = pages.where("host is not null")
    each = F.xxhash64("text")
    totals = pages.groupBy("host").agg((F.count("*") if copies else F.countDistinct(each)).alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _counted), lambda line: F.xxhash64(line)))
    there = pages.where("text is not null")

    def often(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        common = counts.join(totals, "host").where(F.col("n") > max_ratio * F.col("pages"))
        return common.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))

    hosts = often(there.select("host", F.explode(keys).alias("line")))
    if copies:
        return hosts
    # A line has no more texts than rows, so only these lines are counted by text.
    hosts = _small(staged(hosts))
    found = there.join(hosts, "host").select("host", each.alias("each"), F.array_intersect(keys, "lines").alias("found"))
    return often(found.select("host", "each", F.explode("found").alias("line")).distinct())


def line_dedup(
    df: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.1, least: int = 2,
    copies: bool = False,
) -> DataFrame:
    """``df`` without the boilerplate lines of each row's host, and ``n_lines``, ``n_dropped`` (int).

    See ``boilerplate_lines`` for what goes: every occurrence on that host, the first one too. Lines end
    at ``\\n`` and are compared as they stand; those kept are joined by ``\\n``, so a text can become empty.
    A null text stays null with 0 lines, a row without a host stays as it is. Copies of a text are one
    page, so that they don't make its lines boilerplate, and null texts of a host are one as well; with
    ``copies`` every row is a page. Columns ``n_lines`` and ``n_dropped`` of ``df`` are replaced. An empty table gives an empty one.
    """
    hosts = _small(staged(boilerplate_lines(df, host_col, text_col, max_ratio, least, copies)))
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped") or c in (host_col, text_col)]
    plain = df.select(names).toDF(*[f"c{k}" for k in range(len(names))])
    host, text = (F.col(f"c{names.index(c)}").cast("string") for c in (host_col, text_col))
    joined = plain.join(hosts, host == F.col("host"), "left")
    every = _lines(text)
    kept = F.filter(every, lambda line: ~_counted(line) | ~F.array_contains(F.col("lines"), F.xxhash64(line)))
    split = joined.withColumn("every", F.coalesce(F.size(every), F.lit(0)).cast("int")).withColumn(
        "kept", F.when(F.col("lines").isNull(), every).otherwise(kept))
    columns = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col(f"c{k}").alias(c)
               for k, c in enumerate(names)]
    lines = F.when(text.isNull(), 0).otherwise(F.col("every"))
    gone = F.when(text.isNull(), 0).otherwise(F.col("every") - F.size("kept"))
    return split.select(*columns, lines.alias("n_lines"), gone.alias("n_dropped"))
