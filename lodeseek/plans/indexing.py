"""Building the document tables and keeping them current."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import keys
from lodeseek.operators import deltas
from lodeseek.operators.match import commit_fields, file_fields
from lodeseek.operators.occurrences import append_rows
from lodeseek.operators.postings import vocabulary
from lodeseek.schemas import REPO_KEY, TABLES
from lodeseek.settings import Limits
from lodeseek.sources import catalog, snapshots
from lodeseek.sources.store import DocumentStore

REF_KEY = list(deltas.REF_KEY)


@dataclass(frozen=True)
class Sources:
    """Tables that describe the repositories as they are now."""

    repositories: DataFrame
    branches: DataFrame
    tree: DataFrame
    blobs: DataFrame
    reach: DataFrame
    log: DataFrame


def checkpoint_lag(branches: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Refs whose tip is not the one indexed last; a ref never indexed starts from nothing."""
    last = checkpoints.select(*REF_KEY, F.col("hash").alias("last"))
    tips = catalog.resolved_tips(branches).join(last, REF_KEY, "left")
    tips = tips.withColumn("last", F.coalesce("last", F.lit(keys.EMPTY_TREE)))
    return tips.filter(F.col("last") != F.col("tip"))


def build(sources: Sources, limits: Limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, commits, checkpoints) of all refs to index, from nothing."""
    refs = catalog.select_refs(catalog.resolved_tips(sources.branches), sources.repositories)
    chosen = refs.select(*REF_KEY)
    tree = sources.tree.join(chosen, REF_KEY, "left_semi")
    reach = sources.reach.join(chosen, REF_KEY, "left_semi")
    files = snapshots.build_files(snapshots.documents_of_tree(tree), sources.blobs, limits)
    commits = snapshots.build_commits(snapshots.commits_of_reach(reach), sources.log)
    return files, commits, refs.select(*REF_KEY, F.col("tip").alias("hash"))


def apply_delta(
    files: DataFrame, delta: DataFrame, blobs: DataFrame, limits: Limits
) -> DataFrame:
    """File documents after a tree delta. Contents are read only for documents that are new."""
    changes = deltas.file_changes(delta)
    missing = deltas.documents_to_insert(files, changes).withColumn("refs", F.array_sort("add_refs"))
    return deltas.update_documents(files, changes).unionByName(snapshots.build_files(missing, blobs, limits))


def apply_commit_delta(commits: DataFrame, gained: DataFrame, lost: DataFrame, log: DataFrame) -> DataFrame:
    """Commit documents after commits were gained and lost."""
    changes = deltas.commit_changes(gained, lost)
    missing = deltas.documents_to_insert(commits, changes).withColumn("refs", F.array_sort("add_refs"))
    return deltas.update_documents(commits, changes).unionByName(snapshots.build_commits(missing, log))


def purge_repository(docs: DataFrame, project: str, repository: str) -> DataFrame:
    return docs.filter(~((F.col("project") == project) & (F.col("repository") == repository)))


def reindex_ref(
    files: DataFrame, tree: DataFrame, blobs: DataFrame, project: str, repository: str, ref: str, limits: Limits
) -> DataFrame:
    """Takes a ref off every document of a repository, then adds it where the tree has it now.

    For a ref that is gone the tree has no rows and only the removal stays.
    """
    mine = (F.col("project") == project) & (F.col("repository") == repository)
    cleared = deltas.remove_ref(files, ref, mine)
    now = tree.filter(mine & (F.col("ref") == ref))
    return apply_delta(cleared, deltas.tree_delta(now.limit(0), now), blobs, limits)


def full_build(store: DocumentStore, sources: Sources, limits: Limits, tokens: bool = False) -> int | None:
    """Writes a whole new version; readers keep the old one until it is published.

    With ``tokens`` it also writes token rows, which later updates keep current.
    """
    if not limits.indexing_enabled:
        return None
    version = store.begin()
    # Branches are read once: trees and checkpoints must speak of the same tips.
    sources = replace(sources, branches=store.stage(sources.branches, "branches"))
    files, commits, marks = build(sources, limits)
    chosen = marks.select(*REF_KEY)
    rows = {
        "files": files, "commits": commits, "checkpoints": marks,
        "tree": sources.tree.join(chosen, REF_KEY, "left_semi"), "reach": sources.reach.join(chosen, REF_KEY, "left_semi"),
    }
    for table, df in rows.items():
        store.write(table, df)
    if tokens:
        append_rows(store.append, [(store.written("files"), file_fields(limits)), (store.written("commits"), commit_fields(limits))])
    store.publish(version, dict.fromkeys(rows), tokens)
    return version


def sync_refs(
    store: DocumentStore, sources: Sources, targets: DataFrame, limits: Limits, purged: DataFrame | None = None
) -> int | None:
    """Brings the documents of many refs in line with the current snapshots, in one version.

    ``targets`` has (project, repository, ref). A target without a tip, or one no longer selected, loses its
    documents. What changed is the difference of the stored and the current snapshots, so a repeated or late run
    ends in the same state, nothing is read twice because it has no document, and no change writes no version. ``purged`` has (project, repository) of repositories to begin anew: all their documents go, and the refs
    that the catalog lists now are indexed from nothing, so nothing is left of a repository that is no longer listed.
    """
    if not limits.indexing_enabled:
        return None
    if purged is not None and purged.isEmpty():
        purged = None
    old_version = store.latest()
    version = store.begin()
    tips = catalog.select_refs(catalog.resolved_tips(sources.branches), sources.repositories)
    wanted = targets.select(*REF_KEY)
    if purged is not None:
        purged = store.stage(purged.select(*REPO_KEY).distinct(), "purged")
        held = [store.around(t, purged, old_version).select(*REF_KEY) for t in ("tree", "reach", "checkpoints")]
        refs = held[0].union(held[1]).union(held[2]).union(tips.select(*REF_KEY))
        wanted = wanted.union(refs.join(purged, list(REPO_KEY), "left_semi"))
    wanted = store.stage(wanted.distinct(), "targets")
    if wanted.isEmpty():
        return old_version
    # Tips are read once: trees and checkpoints must speak of the same ones.
    tips = store.stage(tips.join(wanted, REF_KEY, "left_semi").select(*REF_KEY, "tip"), "tips")
    files, commits, marks, tree, reach = (
        store.around(t, wanted, old_version) for t in ("files", "commits", "checkpoints", "tree", "reach"))

    def kept(df: DataFrame) -> DataFrame:
        return df if purged is None else df.join(purged, list(REPO_KEY), "left_anti")

    def now(df: DataFrame) -> DataFrame:
        return df.join(tips.select(*REF_KEY), REF_KEY, "left_semi")

    def before(df: DataFrame) -> DataFrame:
        return kept(df).join(wanted, REF_KEY, "left_semi")

    def gone(df: DataFrame, unit: str) -> set[int]:
        return set() if purged is None else set(_buckets(store, df.join(purged, list(REPO_KEY), "left_semi"), unit))

    file_delta = store.stage(deltas.tree_delta(before(tree), now(sources.tree)), "tree_delta")
    gained, lost = deltas.commit_delta(before(reach), now(sources.reach))
    gained, lost = store.stage(gained, "gained"), store.stage(lost, "lost")
    changes = {
        "files": store.stage(deltas.file_changes(file_delta), "file_changes"),
        "commits": store.stage(deltas.commit_changes(gained, lost), "commit_changes"),
    }
    replaced: dict[str, list[int] | None] = {}
    fields = {"files": file_fields(limits), "commits": commit_fields(limits)}
    added, removed = [], []
    for table, docs in (("files", files), ("commits", commits)):
        change = changes[table]
        replaced[table] = sorted(set(_buckets(store, change, "doc_id")) | gone(docs, "doc_id"))
        if not replaced[table]:
            continue
        touched = kept(docs.filter(F.col("bucket").isin(replaced[table])).drop("bucket"))
        missing = deltas.documents_to_insert(touched, change).withColumn("refs", F.array_sort("add_refs"))
        if table == "files":
            # Contents are fetched before they are decoded, so only those of new documents are.
            missing = store.stage(missing, "new_files")
            blobs = snapshots.needed_blobs(sources.blobs, missing, limits.max_file_size)
            new = snapshots.build_files(missing, store.stage(blobs, "new_blobs"), limits)
        else:
            new = snapshots.build_commits(missing, sources.log)
        if store.has_tokens(old_version):
            new = store.stage(new, f"added_{table}")
            added.append((new, fields[table]))
            removed.append((deltas.removed_documents(touched, change), fields[table]))
            if purged is not None:
                removed.append((docs.join(purged, list(REPO_KEY), "left_semi"), fields[table]))
        store.write(table, deltas.update_documents(touched, change).unionByName(new))
    fresh = tips.select(*REF_KEY, F.col("tip").alias("hash"))
    moved = marks.join(wanted, REF_KEY, "left_semi").select(*fresh.columns)
    moved = moved.join(fresh, fresh.columns, "left_anti").union(fresh.join(moved, fresh.columns, "left_anti"))
    narrow = {
        "tree": (tree, now(sources.tree), file_delta, "path"),
        "reach": (reach, now(sources.reach), gained.union(lost), "hash"),
        "checkpoints": (marks, fresh, moved, "ref"),
    }
    for table, (old, new, change, unit) in narrow.items():
        replaced[table] = sorted(set(_buckets(store, change, unit)) | gone(old, unit))
        if replaced[table]:
            others = old.filter(F.col("bucket").isin(replaced[table])).join(wanted, REF_KEY, "left_anti")
            mine = new.filter(store.buckets.of(unit).isin(replaced[table]))
            store.write(table, others.select(*TABLES[table].names).unionByName(mine.select(*TABLES[table].names)))
    if not any(replaced.values()):
        return old_version
    if added:
        append_rows(store.append, added, removed)
    store.publish(version, replaced, bool(added))
    return version


def reindex_repository(
    store: DocumentStore, sources: Sources, project: str, repository: str, limits: Limits
) -> int | None:
    """Deletes a repository's documents and indexes the refs that the catalog lists now from nothing."""
    one = store.spark.createDataFrame([(project, repository)], "project string, repository string")
    none = sources.branches.select(*REF_KEY).limit(0)
    return sync_refs(store, sources, none, limits, one)


def _buckets(store: DocumentStore, df: DataFrame, unit: str) -> list[int]:
    # At most one number per bucket of the store.
    return sorted(r["b"] for r in df.select(store.buckets.of(unit).alias("b")).distinct().collect())


def index_vocabulary(store: DocumentStore, version: int | None = None) -> None:
    """Writes the document frequencies of a version, for scores that need no scan of the texts."""
    version = store.latest() if version is None else version
    limits = Limits()
    words = vocabulary(store.read("files", version), file_fields(limits)).unionByName(
        vocabulary(store.read("commits", version), commit_fields(limits)))
    store.write_vocabulary(words, version)


def update_all(store: DocumentStore, sources: Sources, limits: Limits) -> int | None:
    """Indexes every selected ref whose tip moved since the last run, and drops those that are gone."""
    refs = catalog.select_refs(sources.branches, sources.repositories)
    marks = store.read("checkpoints")
    gone = marks.select(*REF_KEY).join(refs.select(*REF_KEY), REF_KEY, "left_anti")
    return sync_refs(store, sources, checkpoint_lag(refs, marks).select(*REF_KEY).union(gone), limits)
