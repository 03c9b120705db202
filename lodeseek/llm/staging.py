"""Intermediate tables in the shared folder, and rows packed into one blob per part."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lodeseek.session import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to a new folder below ``spark.checkpoint.dir`` and read back.

    Cuts the lineage with files that every executor can read again. The shuffles of the write are
    dropped when it ends, so the disk holds those of one step at a time.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def on_executors(spark: SparkSession) -> None:
    """Sends this package to the executors once, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_lodeseek_sent", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/lodeseek", "zip", root, "lodeseek")
    context.addPyFile(archive)
    context._lodeseek_sent = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a slice holds about ``most`` bytes of ``column``, a row at least."""
    for batch in batches:
        rows = batch.num_rows
        if rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        lo = 0
        while lo < rows:
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def long_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an integer column with 0 for null, and which of them are there."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), there


def scattered(part: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, list[bytes]]]:
    """Rows grouped by ``part``: the parts that occur and each column's values of a part as bytes."""
    order = np.argsort(part, kind="stable")
    ranked = part[order]
    firsts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
    bounds = np.r_[firsts, len(ranked)]
    blobs = {}
    for name, values in columns.items():
        moved = values[order]
        blobs[name] = [moved[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return ranked[firsts], blobs


def gathered(
    batches: Iterator[pa.RecordBatch], key: str, kinds: dict[str, type],
) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The values of each part of batches that are sorted by ``key``, one part at a time."""
    now, held = None, {name: [] for name in kinds}

    def whole() -> dict[str, np.ndarray]:
        return {name: np.frombuffer(b"".join(held[name]), kinds[name]) for name in kinds}

    for batch in batches:
        parts = batch.column(key).to_pylist()
        columns = {name: batch.column(name) for name in kinds}
        for row, part in enumerate(parts):
            if now is not None and part != now:
                yield now, whole()
                held = {name: [] for name in kinds}
            now = part
            for name in kinds:
                held[name].append(columns[name][row].as_py())
    if now is not None:
        yield now, whole()
