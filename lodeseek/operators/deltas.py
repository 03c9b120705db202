"""Differences between snapshots, and their effect on the document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import keys
from lodeseek.schemas import REPO_KEY

REF_KEY = (*REPO_KEY, "ref")
_NO_REFS = "array<string>"


def tree_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose blob differs between two snapshots, with status A, D or M.

    A rename is a D and an A, a copy is an A; a path that keeps its blob is no change.
    """
    key = [*REF_KEY, "path"]
    before = old.select(*key, F.col("blob").alias("old_blob"))
    after = new.select(*key, F.col("blob").alias("new_blob"))
    status = F.when(F.col("old_blob").isNull(), "A").when(F.col("new_blob").isNull(), "D").otherwise("M")
    both = before.join(after, key, "full_outer")
    return both.filter(~F.col("old_blob").eqNullSafe(F.col("new_blob"))).withColumn("status", status)


def commit_delta(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits gained, commits lost) per ref between two reachable sets."""
    key = [*REF_KEY, "hash"]
    return new.join(old, key, "left_anti").select(*key), old.join(new, key, "left_anti").select(*key)


def file_changes(delta: DataFrame) -> DataFrame:
    """Tree delta -> per file document, the refs to add and the refs to drop."""
    sides = F.array_compact(F.array(
        F.when(F.col("old_blob").isNotNull(), F.struct(F.col("old_blob").alias("blob"), F.lit(False).alias("added"))),
        F.when(F.col("new_blob").isNotNull(), F.struct(F.col("new_blob").alias("blob"), F.lit(True).alias("added"))),
    ))
    rows = delta.select(*REF_KEY, "path", F.explode(sides).alias("side")).select(*REF_KEY, "path", "side.*")
    return _per_document(rows, ["blob", "path"], keys.file_id())


def commit_changes(gained: DataFrame, lost: DataFrame) -> DataFrame:
    """Commit delta -> per commit document, the refs to add and the refs to drop."""
    rows = gained.withColumn("added", F.lit(True)).unionByName(lost.withColumn("added", F.lit(False)))
    return _per_document(rows, ["hash"], keys.commit_id())


def _per_document(rows: DataFrame, identity: list[str], doc_id: Column) -> DataFrame:
    # A document has at most as many refs as its repository indexes.
    grouped = rows.groupBy(*REPO_KEY, *identity).agg(
        F.collect_set(F.when(F.col("added"), F.col("ref"))).alias("add_refs"),
        F.collect_set(F.when(~F.col("added"), F.col("ref"))).alias("drop_refs"),
    )
    return grouped.select(doc_id.alias("doc_id"), "*")


def merged_refs(refs: Column, add: Column, drop: Column) -> Column:
    """Refs of a document after dropping some and adding some."""
    empty = F.array().cast(_NO_REFS)
    refs, add, drop = (F.coalesce(c, empty) for c in (refs, add, drop))
    return F.array_sort(F.array_union(F.array_except(refs, drop), add))


def update_documents(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Existing documents with their new refs; a document on no ref any more is gone."""
    change = changes.select("doc_id", "add_refs", "drop_refs")
    refs = merged_refs(F.col("refs"), F.col("add_refs"), F.col("drop_refs"))
    return docs.join(change, "doc_id", "left").withColumn("refs", refs).filter(F.size("refs") > 0).select(*docs.columns)


def removed_documents(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Existing documents that the changes leave without a ref."""
    dropped = changes.filter(F.size("drop_refs") > 0).select("doc_id", "add_refs", "drop_refs")
    refs = merged_refs(F.col("refs"), F.col("add_refs"), F.col("drop_refs"))
    return docs.join(dropped, "doc_id").filter(F.size(refs) == 0).select(*docs.columns)


def documents_to_insert(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that add refs to a document which does not exist yet."""
    added = changes.filter(F.size("add_refs") > 0)
    return added.join(docs.select("doc_id"), "doc_id", "left_anti")


def add_ref(docs: DataFrame, ref: str, which: Column) -> DataFrame:
    """Adds a ref to some documents; a ref that is there already changes nothing."""
    added = F.array_sort(F.array_union("refs", F.array(F.lit(ref))))
    return docs.withColumn("refs", F.when(which, added).otherwise(F.col("refs")))


def remove_ref(docs: DataFrame, ref: str, which: Column | None = None) -> DataFrame:
    """Takes a ref off some documents; those left without a ref are gone."""
    removed = F.array_remove("refs", ref)
    kept = removed if which is None else F.when(which, removed).otherwise(F.col("refs"))
    return docs.withColumn("refs", kept).filter(F.size("refs") > 0)
