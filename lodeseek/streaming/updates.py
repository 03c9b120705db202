"""Keeping the document tables current from a stream of ref-change events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseek.operators.deltas import REF_KEY
from lodeseek.plans.indexing import Sources, sync_refs
from lodeseek.schemas import REPO_KEY
from lodeseek.settings import Limits
from lodeseek.sources.catalog import branch_catalog, select_refs
from lodeseek.sources.store import DocumentStore

UPDATE, REINDEX, PURGE = "update", "reindex", "purge"


def coalesce_events(events: DataFrame) -> DataFrame:
    """One row per ref: its last change. Counted map-side first, so a busy ref is no hot spot."""
    last = F.max_by("change_type", F.struct("ts", "event_id")).alias("change_type")
    return events.groupBy(*REF_KEY).agg(last, F.count(F.lit(1)).alias("events"))


def pending_changes(events: DataFrame, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keeps the last change of every ref as streaming state and writes what each batch changes of it.

    The state is one row per ref. Each batch writes a folder of its own with the refs it has events for, so a batch
    that is run again replaces only itself. ``pending_state`` reads the folders.
    """

    def on_batch(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = coalesce_events(events).writeStream.outputMode("update").foreachBatch(on_batch)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def pending_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last change of every ref and its number of events so far, from what ``pending_changes`` wrote."""
    last = F.max_by(F.struct("change_type", "events"), "batch").alias("last")
    return spark.read.parquet(folder).groupBy(*REF_KEY).agg(last).select(*REF_KEY, "last.*")


def route_events(changes: DataFrame, branches: DataFrame) -> DataFrame:
    """Changes with the action they ask for; changes to a ref that is no branch are dropped."""
    action = (
        F.when(F.col("change_type") == "REPO_DELETED", PURGE)
        .when(F.col("change_type") == "DELETE", REINDEX)
        .otherwise(UPDATE)
    )
    known = branch_catalog(branches).select(*REF_KEY, F.lit(True).alias("known"))
    routed = changes.withColumn("action", action).join(known, list(REF_KEY), "left")
    return routed.filter((F.col("action") != UPDATE) | F.col("known")).drop("known")


def apply_events(events: DataFrame, store: DocumentStore, sources: Sources, limits: Limits) -> int | None:
    """One batch of events: at most one job per ref, working on the current tip."""
    routed = route_events(coalesce_events(events), sources.branches)
    selected = select_refs(branch_catalog(sources.branches), sources.repositories).select(*REF_KEY)
    updates = routed.filter(F.col("action") == UPDATE).join(selected, list(REF_KEY), "left_semi")
    targets = updates.unionByName(routed.filter(F.col("action") == REINDEX))
    # A purge hides behind later events of the same repository, so it is taken from all events.
    purged = events.filter(F.col("change_type") == "REPO_DELETED").select(*REPO_KEY).distinct()
    return sync_refs(store, sources, targets, limits, purged)


def run_updates(
    events: DataFrame, store: DocumentStore, sources: Callable[[], Sources], limits: Limits, checkpoint: str,
    **trigger: object,
) -> StreamingQuery:
    """Starts the update query over a streaming frame of ref events.

    ``sources`` is called per batch, so a batch sees the snapshots of that moment. A batch that
    is run again ends in the same documents.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            apply_events(batch, store, sources(), limits)

    writer = events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
