"""Identities of documents, repositories and refs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.functions.columns import text

MAIN_REF = "refs/heads/master"
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # fixed value: hash of a tree without files


@dataclass(frozen=True)
class Buckets:
    """How stored tables are split.

    A bucket is one of ``groups`` repository groups times one of ``slices`` parts of it: a
    repository is found in ``slices`` neighbouring buckets, and a huge one is spread over them.
    The defaults suit some hundred gigabytes; for a hundred terabytes take 1,024 groups of 64.
    """

    groups: int = 64
    slices: int = 16

    def group(self, project: Column | str = "project", repository: Column | str = "repository") -> Column:
        return F.pmod(F.xxhash64(project, repository), F.lit(self.groups)).cast("int")

    def first(self, project: Column | str = "project", repository: Column | str = "repository") -> Column:
        """The first bucket of a repository."""
        return self.group(project, repository) * self.slices

    def of(self, unit: Column | str = "doc_id") -> Column:
        """The bucket of a row that ``unit`` identifies within its repository."""
        return (self.first() + F.pmod(F.xxhash64(unit), F.lit(self.slices)).cast("int")).cast("int")


def repo_key() -> Column:
    return F.concat_ws("^", "project", "repository")


def ref_key() -> Column:
    return F.concat_ws("^", "project", "repository", "ref")


def file_id(blob: Column | str = "blob", path: Column | str = "path") -> Column:
    return F.concat(repo_key(), F.lit("^"), blob, F.lit("^:/"), path)


def commit_id(hash_: Column | str = "hash") -> Column:
    return F.concat(repo_key(), F.lit("^"), hash_)


def display_refs(refs: Column | str = "refs") -> Column:
    return F.array_sort(F.array_distinct(refs))


def primary_ref(refs: Column | str = "refs") -> Column:
    return F.when(F.array_contains(refs, MAIN_REF), F.lit(MAIN_REF)).otherwise(F.array_min(refs))


def printed_date(column: Column | str = "commitdate") -> Column:
    return text(F.date_format(column, "yyyy-MM-dd HH:mm"))
