"""Repositories, branches, refs to index, and read grants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.schemas import REPO_KEY


def repository_catalog(repositories: DataFrame) -> DataFrame:
    """One row per repository; the first one, by names, stays where a key repeats."""
    rest = [c for c in repositories.columns if c not in REPO_KEY]
    first = F.min(F.struct(*rest)).alias("first")
    return repositories.groupBy(*REPO_KEY).agg(first).select(*REPO_KEY, "first.*")


def branch_catalog(branches: DataFrame) -> DataFrame:
    """One row per ref of a repository; the greatest tip stays where a ref repeats."""
    return branches.groupBy(*REPO_KEY, "ref").agg(F.max("tip").alias("tip"))


def resolved_tips(branches: DataFrame) -> DataFrame:
    """Refs whose tip is a whole hash; the others are left alone."""
    return branch_catalog(branches).filter(F.length("tip") == 40)


def select_refs(branches: DataFrame, repositories: DataFrame) -> DataFrame:
    """Branches that their repository wants indexed.

    The whole ref name must match the repository's pattern, or the ref is the default branch
    and the pattern matches ``HEAD``. A pattern that does not compile selects nothing.
    """
    valid = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("ref_regex"))
    patterns = repository_catalog(repositories).select(
        *REPO_KEY, "default_branch", F.concat(F.lit(r"\A(?:"), valid, F.lit(r")\z")).alias("pattern")
    ).filter("pattern is not null")
    whole = F.rlike("ref", F.col("pattern"))
    head = (F.col("ref") == F.col("default_branch")) & F.rlike(F.lit("HEAD"), F.col("pattern"))
    return branches.join(patterns, list(REPO_KEY)).filter(whole | head).select(*branches.columns)


def readable_repositories(repositories: DataFrame, grants: DataFrame, user: str) -> DataFrame:
    mine = grants.filter(F.col("user_id") == user).select(*REPO_KEY)
    return repositories.join(mine, list(REPO_KEY), "left_semi")
