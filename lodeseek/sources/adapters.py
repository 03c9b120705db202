"""Document tables derived from a folder of ``documents/events/conversations/pages`` Parquet.

The folder holds no version-control data, so projects, refs, trees and histories are laid over
its rows. Every row takes part; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions import keys
from lodeseek.functions.text import charcount, extension, linecount
from lodeseek.settings import DEFAULT_REF_REGEX

MASTER, DEVELOP = "refs/heads/master", "refs/heads/develop"
FEATURE_A, FEATURE_B = "refs/heads/feature/a", "refs/heads/feature/b"

OLD_TIP, NEW_TIP = "old", "new"
CUT = "2024-01-20"  # commits from this day on are on the new tip only


# Known columns spare a job per read that would look them up in the files.
COLUMNS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def _pick(number: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _refs(number: Column) -> Column:
    some = F.array_compact(F.array(
        F.when(number % 2 == 0, MASTER),
        F.when(number % 3 == 0, DEVELOP),
        F.when(number % 5 == 0, FEATURE_A),
    ))
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(FEATURE_B)))


def _document_path() -> Column:
    suffix = _pick(F.col("doc_id"), ".py", ".java", ".md", ".txt", ".sql", "")
    return F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix)


def _as_files(df: DataFrame) -> DataFrame:
    return df.select(
        keys.file_id().alias("doc_id"), "project", "repository", "refs", "blob", "path",
        extension("path").alias("extension"), "contents",
        charcount("contents").alias("charcount"), linecount("contents").alias("linecount"),
    )


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "documents")
    return _as_files(df.select(
        F.col("lang").alias("project"), F.col("source").alias("repository"),
        _refs(F.col("doc_id")).alias("refs"), F.sha1("text").alias("blob"),
        _document_path().alias("path"), F.col("text").alias("contents"),
    ))


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "pages")
    return _as_files(df.select(
        F.lit("web").alias("project"),
        F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("repository"),
        F.array(F.lit(MASTER)).alias("refs"), F.sha1("html").alias("blob"),
        F.col("url").alias("path"), F.col("html").alias("contents"),
    ))


def _event_place() -> tuple[Column, Column]:
    number = F.col("event_id")
    project = _pick(number, "en", "fr", "de", "es")
    repository = F.concat(F.lit("src"), (F.floor(number / 4) % 20).cast("string"))
    return project, repository


def event_commits(spark: SparkSession, folder: str) -> DataFrame:
    project, repository = _event_place()
    user = F.col("user_id").cast("string")
    df = table(spark, folder, "events").select(
        project.alias("project"), repository.alias("repository"),
        _refs(F.col("event_id")).alias("refs"),
        F.sha1(F.col("event_id").cast("string")).alias("hash"),
        F.col("ts").cast("timestamp").alias("commitdate"),
        F.concat(F.lit("User "), user).alias("authorname"),
        F.concat(F.lit("user"), user, F.lit("@example.com")).alias("authoremail"),
        F.col("event_type").alias("subject"), F.col("props").alias("body"),
    )
    return df.select(keys.commit_id().alias("doc_id"), "*")


def message_commits(spark: SparkSession, folder: str) -> DataFrame:
    first_break = F.instr("text", "\n")
    subject = F.when(first_break > 0, F.substring_index("text", "\n", 1)).otherwise(F.col("text"))
    body = F.when(first_break > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit(""))
    identity = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    df = table(spark, folder, "conversations").select(
        F.lit("talk").alias("project"), F.lit("log").alias("repository"),
        F.array(F.lit(MASTER)).alias("refs"), F.sha1(identity).alias("hash"),
        F.lit(None).cast("timestamp").alias("commitdate"),
        F.col("role").alias("authorname"), F.lit("").alias("authoremail"),
        subject.alias("subject"), body.alias("body"),
    )
    return df.select(keys.commit_id().alias("doc_id"), "*")


def commit_log(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records; sign-ups come without a body field."""
    project, repository = _event_place()
    user = F.col("user_id").cast("string")
    parts = [
        F.sha1(F.col("event_id").cast("string")),
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"),
        F.concat(F.lit("User "), user),
        F.concat(F.lit("user"), user, F.lit("@example.com")),
        F.col("event_type"),
    ]
    short = F.concat_ws("\u0002", *parts)
    record = F.when(F.col("event_type") == "signup", short).otherwise(
        F.concat_ws("\u0002", *parts, F.col("props"))
    )
    return table(spark, folder, "events").select(
        project.alias("project"), repository.alias("repository"), record.alias("record")
    )


def repositories(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "documents").select("lang", "source").distinct()
    return df.select(
        F.col("lang").alias("project"), F.col("source").alias("repository"),
        F.upper("lang").alias("projectname"), F.upper("source").alias("repositoryname"),
        F.lit(MASTER).alias("default_branch"), F.lit(DEFAULT_REF_REGEX).alias("ref_regex"),
    )


def branches(spark: SparkSession, folder: str) -> DataFrame:
    """Every ref that a file is on; its tip stands for the set of blobs seen on it."""
    df = document_files(spark, folder).select("project", "repository", F.explode("refs").alias("ref"), "blob")
    return df.groupBy("project", "repository", "ref").agg(
        F.sha1(F.concat_ws("^", F.max("blob"), F.count(F.lit(1)).cast("string"))).alias("tip")
    )


def grants(spark: SparkSession, folder: str) -> DataFrame:
    number = F.regexp_extract("repository", "[0-9]+$", 0).cast("bigint") % 5
    return repositories(spark, folder).select(number.cast("string").alias("user_id"), "project", "repository")


SNAPSHOT = ("project", "repository", "refs", "path", "contents")
_EDITED = "project = 'de'"


def _old_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id"), F.col("lang").alias("project"), F.col("source").alias("repository"),
        _refs(F.col("doc_id")).alias("refs"), _document_path().alias("path"), F.col("text").alias("contents"),
    )


def _new_documents(spark: SparkSession, folder: str) -> DataFrame:
    toxic = table(spark, folder, "labels").filter("toxic = 1").select("doc_id")
    changed = F.when(F.expr(_EDITED), F.concat("contents", F.lit(" x"))).otherwise(F.col("contents"))
    moved = F.when(F.col("project") == "es", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    kept = _old_documents(spark, folder).join(toxic, "doc_id", "left_anti")
    return kept.select("project", "repository", "refs", moved.alias("path"), changed.alias("contents"))


def _snapshot(spark: SparkSession, folder: str, tip: str) -> DataFrame:
    if tip == OLD_TIP:
        return _old_documents(spark, folder).select(*SNAPSHOT)
    return _new_documents(spark, folder).unionByName(page_files(spark, folder).select(*SNAPSHOT))


def tree(spark: SparkSession, folder: str, tip: str) -> DataFrame:
    """Snapshot rows. Against the old tip, the new one edits all ``de`` documents, moves all
    ``es`` documents, lacks the documents labelled toxic, and has the pages on top."""
    return _snapshot(spark, folder, tip).select(
        "project", "repository", F.explode("refs").alias("ref"), "path", F.sha1("contents").alias("blob")
    )


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Contents of both tips, once per blob."""
    # What the new tip has unchanged is read from the old one.
    new = _new_documents(spark, folder).filter(_EDITED).unionByName(page_files(spark, folder).select(*SNAPSHOT))
    both = _snapshot(spark, folder, OLD_TIP).unionByName(new)
    content = both.select(F.encode("contents", "UTF-8").alias("content"))
    return content.groupBy(F.sha1("content").alias("blob")).agg(F.first("content").alias("content")).select(
        "blob", F.octet_length("content").alias("size"), "content"
    )


def reach(spark: SparkSession, folder: str, tip: str) -> DataFrame:
    """Commits reachable from a tip. The rewritten history of the new tip has no ``error`` commits."""
    df = table(spark, folder, "events")
    df = df.filter(F.col("ts") < F.lit(CUT)) if tip == OLD_TIP else df.filter(F.col("event_type") != "error")
    project, repository = _event_place()
    return df.select(
        project.alias("project"), repository.alias("repository"),
        F.explode(_refs(F.col("event_id"))).alias("ref"),
        F.sha1(F.col("event_id").cast("string")).alias("hash"),
    )


def ref_events(spark: SparkSession, folder: str) -> DataFrame:
    return shape_ref_events(table(spark, folder, "events"))


def shape_ref_events(events: DataFrame) -> DataFrame:
    """Also usable on a streaming read of ``events``."""
    project, repository = _event_place()
    change = (
        F.when(F.col("event_type") == "signup", "ADD")
        .when(F.col("event_type") == "error", "DELETE")
        .otherwise("UPDATE")
    )
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        project.alias("project"), repository.alias("repository"),
        _pick(F.col("event_id"), MASTER, DEVELOP, FEATURE_A, FEATURE_B).alias("ref"),
        change.alias("change_type"),
    )
