"""Documents built from repository snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import keys
from lodeseek.functions.text import charcount, decode_text, extension, linecount
from lodeseek.schemas import COMMITS, FILES, REPO_KEY
from lodeseek.settings import Limits

# Fixed value: separator of the fields of a commit record.
FIELD_SEPARATOR = "\u0002"

# Length of the ``prefix`` column of a partitioned blob table.
PREFIX_DIGITS = 3


def within_size(blobs: DataFrame, max_file_size: int) -> DataFrame:
    """Blobs small enough to index; one of unknown size is not."""
    return blobs.filter(F.col("size") <= max_file_size)


def needed_blobs(blobs: DataFrame, places: DataFrame, max_file_size: int) -> DataFrame:
    """Raw contents of the blobs that some places need.

    A blob table partitioned by ``prefix``, the first digits of the blob, is read only there.
    """
    wanted, key = places.select("blob").distinct(), ["blob"]
    if "prefix" in blobs.columns:
        wanted, key = wanted.withColumn("prefix", F.substring("blob", 1, PREFIX_DIGITS)), [*key, "prefix"]
    found = within_size(blobs, max_file_size).join(wanted, key, "left_semi")
    return found.select("blob", "size", "content")


def text_blobs(blobs: DataFrame, max_file_size: int) -> DataFrame:
    """Indexable blobs, decoded and measured once however many paths share them."""
    decoded = within_size(blobs, max_file_size).select("blob", decode_text("content").alias("contents"))
    return decoded.filter("contents is not null").select(
        "blob", "contents", charcount("contents").alias("charcount"), linecount("contents").alias("linecount")
    )


LAST_SECOND = 253_402_300_799  # of the year 9999; later dates are bad ones


def documents_of_tree(tree: DataFrame) -> DataFrame:
    """One row per (blob, path) of a repository with all refs that hold it."""
    return tree.groupBy(*REPO_KEY, "blob", "path").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


def build_files(places: DataFrame, blobs: DataFrame, limits: Limits) -> DataFrame:
    """File documents for (project, repository, blob, path, refs) rows.

    A blob that very many paths share makes one large join partition; it is an inner join, so
    adaptive execution may split that partition.
    """
    joined = places.join(text_blobs(blobs, limits.max_file_size), "blob")
    return joined.select(
        keys.file_id().alias("doc_id"), *REPO_KEY, "refs", "blob", "path",
        extension("path").alias("extension"), "contents", "charcount", "linecount",
    ).select(*FILES.names)


def shape_commits(log: DataFrame) -> DataFrame:
    """Commit fields of raw records; records that lack a field or have a bad one are left out."""
    record = F.regexp_replace("record", r"\A\n", "")
    parts = log.select(*REPO_KEY, F.split(record, FIELD_SEPARATOR, 6).alias("f"))
    epoch = F.get("f", F.lit(1)).try_cast("bigint")
    epoch = F.when(epoch.between(-LAST_SECOND, LAST_SECOND), epoch)
    return parts.select(
        *REPO_KEY, F.get("f", F.lit(0)).alias("hash"), F.timestamp_seconds(epoch).alias("commitdate"),
        F.get("f", F.lit(2)).alias("authorname"), F.get("f", F.lit(3)).alias("authoremail"),
        F.get("f", F.lit(4)).alias("subject"), F.coalesce(F.get("f", F.lit(5)), F.lit("")).alias("body"),
    ).filter((F.length("hash") == 40) & F.col("commitdate").isNotNull() & F.col("subject").isNotNull())


def build_commits(places: DataFrame, log: DataFrame) -> DataFrame:
    """Commit documents for (project, repository, hash, refs) rows."""
    key = [*REPO_KEY, "hash"]
    # The join comes first: for few places the log is not shuffled, and for many the grouping
    # finds the rows where the join left them.
    fields = F.first(F.struct("refs", "commitdate", "authorname", "authoremail", "subject", "body"))
    joined = places.select(*key, "refs").join(shape_commits(log), key)
    once = joined.groupBy(*key).agg(fields.alias("c")).select(*key, "c.*")
    return once.withColumn("doc_id", keys.commit_id()).select(*COMMITS.names)


def commits_of_reach(reach: DataFrame) -> DataFrame:
    """One row per commit of a repository with all refs that reach it."""
    return reach.groupBy(*REPO_KEY, "hash").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


def indexed_tree(files: DataFrame) -> DataFrame:
    """The snapshot that the file documents stand for."""
    return files.select(*REPO_KEY, F.explode("refs").alias("ref"), "path", "blob")


def indexed_reach(commits: DataFrame) -> DataFrame:
    """The reachable sets that the commit documents stand for."""
    return commits.select(*REPO_KEY, F.explode("refs").alias("ref"), "hash")
