"""What is shown of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import keys
from lodeseek.functions.columns import text
from lodeseek.operators.filters import COMMIT, FILE, no_highlight
from lodeseek.schemas import REPO_KEY
from lodeseek.sources.catalog import repository_catalog


def with_names(df: DataFrame, repositories: DataFrame) -> DataFrame:
    """Adds readable project and repository names; documents of unknown repositories go."""
    names = repository_catalog(repositories).select(*REPO_KEY, "projectname", "repositoryname")
    return df.join(names, list(REPO_KEY))


def union_types(files: DataFrame, commits: DataFrame) -> DataFrame:
    """Both document types in one frame, told apart by ``doc_type``."""
    typed = [files.withColumn("doc_type", F.lit(FILE)), commits.withColumn("doc_type", F.lit(COMMIT))]
    return typed[0].unionByName(typed[1], allowMissingColumns=True)


def commit_hit_columns() -> list[Column]:
    return [
        F.col("doc_id"), F.col("project"), F.col("repository"), keys.display_refs().alias("refs"),
        *[text(c).alias(c) for c in ("hash", "subject", "body")],
        keys.printed_date().alias("commitdate"),
        *[text(c).alias(c) for c in ("authorname", "authoremail")],
    ]


def file_hit_columns(no_highlight_extensions: str) -> list[Column]:
    return [
        F.col("doc_id"), F.col("project"), F.col("repository"), keys.display_refs().alias("refs"),
        text("path").alias("path"), text("blob").alias("blob"),
        keys.primary_ref().alias("primary_ref"), text("extension").alias("extension"),
        no_highlight(no_highlight_extensions).alias("no_highlight"), F.col("charcount"), F.col("linecount"),
    ]


def commit_hits(commits: DataFrame) -> DataFrame:
    return commits.select(*commit_hit_columns())


def file_hits(files: DataFrame, no_highlight_extensions: str) -> DataFrame:
    return files.select(*file_hit_columns(no_highlight_extensions))
