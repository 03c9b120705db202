"""Versioned document tables on Parquet.

A version is a set of bucket folders. A new version writes the buckets it changes and names the
others from before, so readers of an older version are never disturbed:

    <root>/<table>/attempt=<id>/bucket=<b>/*.parquet
    <root>/<appended table>/attempt=<id>/*.parquet   token rows: each version names all attempts up to it
    <root>/versions/version=<v>/*.parquet            written last: the version exists from then on

Every attempt at a version writes folders of its own, so one that was cut off is in nobody's way:
the next one starts afresh. The manifest of a version names the attempt of each bucket, and has a
row of its own even if no bucket is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodeseek.functions.keys import Buckets
from lodeseek.operators.filters import bucket_filter, one_repository
from lodeseek.schemas import APPENDED, TABLES, UNITS
from lodeseek.session import write_sorted

_MANIFEST = "table string, bucket int, written string, groups int, slices int"
_HEADER = ""  # in the place of a table: names the attempt of the version itself


class DocumentStore:
    """``root`` is a folder all executors reach. A store keeps the buckets it was begun with."""

    def __init__(self, spark: SparkSession, root: str, buckets: Buckets = Buckets()) -> None:  # noqa: B008
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._base, self._attempt = 0, uuid.uuid4().hex

    def begin(self) -> int:
        """Starts an attempt at the version after the newest one; its number.

        A number whose manifest was begun and never finished is passed over.
        """
        self._base, self._attempt = self.latest(), uuid.uuid4().hex
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
        begun = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
        return max([self._base, *begun]) + 1

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        try:
            rows = self.spark.read.parquet(f"{self.root}/versions").select("version").distinct().collect()
        except AnalysisException:
            return []
        return sorted(int(r["version"]) for r in rows)

    def latest(self) -> int:
        """The newest version; 0 before the first one."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> list[tuple[str, int, str]]:
        # At most one row per table and bucket, and the header.
        if version == 0:
            return []
        folder = f"{self.root}/versions/version={version}"
        rows = self.spark.read.schema(_MANIFEST).parquet(folder).collect()
        if any((r["groups"], r["slices"]) != (self.buckets.groups, self.buckets.slices) for r in rows):
            raise ValueError(f"{self.root} was written with other buckets than {self.buckets}")
        return [(r["table"], r["bucket"], r["written"]) for r in rows]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the newest by default), with its ``bucket`` column."""
        version = self.latest() if version is None else version
        manifest = self._manifest(version)
        rows = [r for r in manifest if r[0] == table]
        schema = TABLES[table]
        if not rows:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))
        base = f"{self.root}/{table}"
        writers = {written for _, _, written in rows}
        if writers == {r[2] for r in manifest if r[0] == _HEADER}:  # all of it was written at once
            paths = [f"{base}/attempt={writers.pop()}"]
        else:
            paths = sorted(f"{base}/attempt={written}/bucket={b}" for _, b, written in rows)
        df = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
        return df.select(*schema.names, "bucket")

    def around(self, table: str, repositories: DataFrame, version: int) -> DataFrame:
        """Rows in the buckets that some repositories may use."""
        groups = repositories.select(self.buckets.group().alias("g")).distinct()
        first = [r["g"] * self.buckets.slices for r in groups.collect()]  # at most ``groups`` numbers
        near = [f + i for f in first for i in range(self.buckets.slices)]
        return self.read(table, version).filter(F.col("bucket").isin(near))

    def repository(self, table: str, project: str, repository: str) -> DataFrame:
        """One repository's rows; only its neighbouring buckets are read."""
        return self.read(table).filter(bucket_filter(project, repository, self.buckets)).filter(one_repository(project, repository))

    def write(self, table: str, df: DataFrame) -> None:
        """Writes bucket folders of the attempt begun last.

        The rebalance hint gives each bucket few files of even size, and splits a bucket that
        one huge repository fills. Rows are sorted so that row groups can be skipped.
        """
        unit = UNITS[table]
        names = TABLES[table].names
        rows = df.select(*names).withColumn("bucket", self.buckets.of(unit)).hint("rebalance", "bucket")
        ordered = rows.sortWithinPartitions("bucket", "project", "repository", unit)
        ordered.write.mode("errorifexists").partitionBy("bucket").parquet(f"{self.root}/{table}/attempt={self._attempt}")

    def written(self, table: str) -> DataFrame:
        """What the attempt begun last wrote of a table."""
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}/attempt={self._attempt}")

    def append(self, table: str, *dfs: DataFrame) -> DataFrame:
        """Writes what the attempt begun last adds to an appended table, part by part, and reads that back."""
        return write_sorted(f"{self.root}/{table}/attempt={self._attempt}", APPENDED[table], *dfs)

    def read_appended(self, table: str, version: int | None = None) -> DataFrame:
        """All rows that a version and those before it appended."""
        version = self.latest() if version is None else version
        paths = [f"{self.root}/{t}/attempt={written}" for t, _, written in self._manifest(version) if t == table]
        if not paths:
            return self.spark.createDataFrame([], APPENDED[table])
        return self.spark.read.schema(APPENDED[table]).parquet(*paths)

    def has_tokens(self, version: int | None = None) -> bool:
        version = self.latest() if version is None else version
        return set(APPENDED) <= {table for table, _, _ in self._manifest(version)}  # an older layout has other tables

    def written_buckets(self, table: str) -> list[int]:
        try:
            df = self.spark.read.parquet(f"{self.root}/{table}/attempt={self._attempt}")
            return [r["bucket"] for r in df.select("bucket").distinct().collect()]
        except AnalysisException:  # no bucket has a row left
            return []

    def publish(self, version: int, replaced: dict[str, list[int] | None], appended: bool = False) -> None:
        """Makes the attempt begun last a version. ``replaced`` names the buckets each table rewrote (None: all).

        ``appended`` says that the attempt wrote to the appended tables.

        Fails if the version exists or another one came since ``begin``, which is how a second
        concurrent writer is refused.
        """
        published = self.versions()
        if version not in published and max(published, default=0) != self._base:
            raise RuntimeError(f"version {max(published)} was published since this attempt began")
        rows = [(_HEADER, -1, self._attempt)]
        before = self._manifest(self._base)
        for table in TABLES:
            buckets = replaced.get(table, [])
            if buckets is None or buckets:
                rows += [(table, b, self._attempt) for b in self.written_buckets(table)]
            if buckets is not None:
                gone = set(buckets)
                rows += [r for r in before if r[0] == table and r[1] not in gone]
        if replaced.get("files", []) is not None:  # not built anew
            rows += [r for r in before if r[0] in APPENDED]
        if appended:
            rows += [(table, -1, self._attempt) for table in APPENDED]
        split = (self.buckets.groups, self.buckets.slices)
        manifest = self.spark.createDataFrame([(*r, *split) for r in rows], _MANIFEST).coalesce(1)
        manifest.write.mode("errorifexists").parquet(f"{self.root}/versions/version={version}")

    def create_views(self, prefix: str = "search", version: int | None = None) -> None:
        """Points the views ``<prefix>_files`` etc. at a version."""
        version = self.latest() if version is None else version
        for table in TABLES:
            self.read(table, version).createOrReplaceTempView(f"{prefix}_{table}")

    def write_vocabulary(self, words: DataFrame, version: int) -> None:
        """(field, term, df) of a version, sorted so that a query reads few row groups."""
        ordered = words.hint("rebalance", "field").sortWithinPartitions("field", "term")
        ordered.write.mode("overwrite").partitionBy("field").parquet(f"{self.root}/vocabulary/version={version}")

    def vocabulary(self, version: int) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/vocabulary/version={version}")
        except AnalysisException:
            return None

    def expire(self, oldest: int) -> int:
        """Removes versions before ``oldest`` and the bucket folders only they use."""
        versions = self.versions()
        if oldest > max(versions, default=0):
            raise ValueError("the newest version cannot be removed")
        kept = {r for v in versions if v >= oldest for r in self._manifest(v)}
        old = [v for v in versions if v < oldest]
        gone = {r for v in old for r in self._manifest(v)} - kept
        folders = {f"{t}/attempt={w}" + ("" if b < 0 else f"/bucket={b}") for t, b, w in gone if t != _HEADER}
        folders |= {f"staging/attempt={w}" for t, _, w in gone if t == _HEADER}
        folders |= {f"vocabulary/version={v}" for v in old}
        # The manifests go first: a version without one does not exist, whatever files are left.
        for folder in [f"versions/version={v}" for v in old] + sorted(folders):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(old)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Writes an intermediate table of the attempt begun last and reads it back."""
        folder = f"{self.root}/staging/attempt={self._attempt}/{name}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)
