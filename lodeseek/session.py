"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# What the library relies on; a cluster session may set more.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# What a write of sorted rows needs least disk with.
LEAN = {
    # The shuffles of the write are dropped when it ends.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Rows are sorted once, for the groups and for the files; a hash aggregation of lists would sort them twice more.
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    # As many parts as the data need are left of these, so that one is sorted in memory: what is shuffled becomes
    # many times larger behind the shuffle.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}

# How sorted rows take little room in Parquet.
SMALL = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",  # what sorted strings have in common is stored once
    "parquet.dictionary.page.size": str(8 << 20),  # so many documents or words of a file are named by number
}


@contextmanager
def lean_writes(spark: SparkSession) -> Iterator[None]:
    """Writes inside take little disk: ``LEAN`` holds for them, and what held before holds again afterwards."""
    before = {key: spark.conf.get(key, None) for key in LEAN}
    for key, value in LEAN.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_sorted(folder: str, schema: StructType, *parts: DataFrame) -> DataFrame:
    """Writes the parts of a table into a new folder and reads it back. The shuffles of one are gone when the next begins."""
    spark = parts[0].sparkSession
    with lean_writes(spark):
        for number, part in enumerate(parts):
            rows = part.select(*schema.names).write.options(**SMALL)
            rows.mode("append" if number else "errorifexists").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def local_session(name: str = "lodeseek", cores: str = "*", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        **RECOMMENDED,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    folder = tempfile.mkdtemp(prefix="lodeseek-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
