"""Facet filters. Each takes the comma list a user types and returns a predicate.

``None`` means the filter is not set; such filters add nothing to the plan.
Frames that hold one document type only may name it through ``doc_type``.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.columns import any_of, literals, text
from lodeseek.functions.keys import Buckets
from lodeseek.functions.text import ref_tokens, tokens
from lodeseek.schemas import REPO_KEY
from lodeseek.settings import split_list

FILE, COMMIT = "file", "commit"


def chosen_types(code: bool = False, filenames: bool = False, commits: bool = False) -> list[str]:
    """Document types to search; no switch on means all of them."""
    if not (code or filenames or commits):
        return [COMMIT, FILE]
    return ([COMMIT] if commits else []) + ([FILE] if code or filenames else [])


def type_filter(code: bool = False, filenames: bool = False, commits: bool = False) -> Column:
    return F.col("doc_type").isin(chosen_types(code, filenames, commits))


def project_filter(projects: str | None) -> Column | None:
    items = split_list(projects)
    return F.col("project").isin(items) if items else None


def repository_filter(repositories: str | None) -> Column | None:
    items = split_list(repositories)
    return F.col("repository").isin(items) if items else None


def one_repository(project: str, repository: str) -> Column:
    return (F.col("project") == project) & (F.col("repository") == repository)


def exact_ref(ref: str) -> Column:
    return F.array_contains("refs", ref)


def _word_groups(text_: str | None, separator: str) -> list[list[str]]:
    groups = [[w.lower() for w in re.split(separator, item) if w] for item in (text_ or "").split(",")]
    return [g for g in groups if g]


def ref_filter(refs: str | None) -> Column | None:
    """All words of one item occur among the ref tokens, which may come from different refs."""
    groups = _word_groups(refs, r"[/\s]+")
    if not groups:
        return None
    have = ref_tokens("refs")
    return any_of(F.size(F.array_except(literals(g), have)) == 0 for g in groups)


def extension_filter(extensions: str | None, doc_type: str | None = None) -> Column | None:
    """Extension in the list; commits pass."""
    items = [e.lower() for e in split_list(extensions)]
    if not items or doc_type == COMMIT:
        return None
    hit = F.col("extension").isin(items)
    return hit if doc_type == FILE else hit | (F.col("doc_type") == COMMIT)


def author_filter(authors: str | None, doc_type: str | None = None) -> Column | None:
    """All words of one item in the name, or all of them in the address; files pass."""
    groups = _word_groups(authors, r"[^A-Za-z0-9_]+")
    if not groups or doc_type == FILE:
        return None
    name, email = tokens("authorname", "name"), tokens("authoremail", "email")
    hit = any_of(
        F.size(F.array_except(literals(g), have)) == 0 for g in groups for have in (name, email)
    )
    return hit if doc_type == COMMIT else hit | (F.col("doc_type") == FILE)


def date_filter(after: str | None, before: str | None, doc_type: str | None = None) -> Column | None:
    """Commit day within both ends, each optional; an unreadable day is no bound; files pass."""
    start, end = _day(after), _day(before)
    if doc_type == FILE or not (start or end):
        return None
    hit = F.lit(True)
    if start:
        hit = hit & (F.col("commitdate") >= F.lit(start).cast("timestamp"))
    if end:
        hit = hit & (F.col("commitdate") < F.date_add(F.lit(end), 1).cast("timestamp"))
    return hit if doc_type == COMMIT else hit | (F.col("doc_type") == FILE)


def _day(written: str | None) -> dt.date | None:
    try:
        return dt.datetime.strptime((written or "").strip(), "%Y-%m-%d").date()
    except ValueError:
        return None


def keep(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for condition in conditions:
        if condition is not None:
            df = df.filter(condition)
    return df


def readable(df: DataFrame, grants: DataFrame, user: str | None, buckets: Buckets | None = None) -> DataFrame:
    """Documents of repositories the user may read; ``None`` is an administrator.

    No broadcast is forced: Spark broadcasts the grants while they are small and otherwise
    shuffles, where adaptive execution splits the documents of a huge repository. On a table
    with ``buckets`` the join names them too, so only those of readable repositories are scanned.
    """
    if user is None:
        return df
    mine = grants.filter(F.col("user_id") == user).select(*REPO_KEY)
    if buckets is None:
        return df.join(mine, list(REPO_KEY), "left_semi")
    first = buckets.first()
    mine = mine.withColumn("bucket", F.explode(F.sequence(first, first + (buckets.slices - 1))))
    return df.join(mine, [*REPO_KEY, "bucket"], "left_semi")


def valid_hits(df: DataFrame, repositories: DataFrame) -> DataFrame:
    """Documents of known repositories that are on at least one ref."""
    known = repositories.select(*REPO_KEY)
    return df.filter(F.size("refs") > 0).join(known, list(REPO_KEY), "left_semi")


def no_highlight(extensions: str) -> Column:
    return F.lower(text("extension")).isin([e.lower() for e in split_list(extensions)])


def bucket_list_filter(projects: str | None, repositories: str | None, buckets: Buckets) -> Column | None:
    """Partition predicate for the repositories that two lists name together."""
    named = [(p, r) for p in split_list(projects) for r in split_list(repositories)]
    return any_of(bucket_filter(p, r, buckets) for p, r in named) if named else None


def bucket_filter(project: str, repository: str, buckets: Buckets) -> Column:
    """Partition predicate for one repository over a bucketed table."""
    first = buckets.first(F.lit(project), F.lit(repository))
    return F.col("bucket").between(first, first + (buckets.slices - 1))
