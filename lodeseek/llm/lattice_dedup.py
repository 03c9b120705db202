"""Near-duplicate vectors by lattice hashing.

A table projects a unit vector by a random Gaussian matrix to eight numbers for each of ``depth`` blocks
and takes the nearest point of the E8 lattice: that is its cell. A vector lies in its own cell and looks
into the neighbouring cells that are nearest to it (``probes``), in each of several tables. Whatever meets
in a cell is compared by cosine in double precision. A cell yields a spanning forest of its links, so what
leaves it grows with its members and not with their pairs.

Links make components. Inside a component all members are then compared, in blocks, and each one's links
are counted; so a link is only missed if nothing at all joins its two ends. Copies of a vector are one
vector with a number of copies throughout. Cells and components beyond a block's size are cut into blocks,
each pair of blocks being a group of its own: G unlike members cost (G / BLOCK)² groups, the price of
exact numbers of links.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.components import connected_components
from lodeseek.llm.staging import on_executors, shuffle_partitions, staged
from lodeseek.llm.vantage_trees import usable
from lodeseek.llm.words import mix

BLOCK = 1024  # members of a group that are compared with each other at once
SKETCH = 1 << 22  # counters that bound the number of members of a cell from above
GROUP = "cell long, label string, size int, lo int, hi int"


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    out = np.zeros((240, 8))
    for row, (i, j, a, b) in enumerate(pairs):
        out[row, [i, j]] = a, b
    signs = np.array([s for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0])
    out[len(pairs):] = signs / 2
    return out


NEIGHBOURS = _neighbours()


def _even_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of whole coordinates with an even sum."""
    point = np.round(x)
    rest = x - point
    odd = np.flatnonzero(point.sum(1).astype(np.int64) & 1)
    worst = np.abs(rest[odd]).argmax(1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return point


def lattice_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 for each row: all coordinates whole or all halves, with an even sum."""
    whole, half = _even_point(x), _even_point(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


class Tables:
    """Random projections; each call gives the cells that vectors lie in and look into."""

    def __init__(self, size: int, tables: int, probes: int, width: float, depth: int, seed: int = 7) -> None:
        rng = np.random.default_rng([seed, size])
        self.matrices = rng.normal(size=(tables, depth, size, 8)) / width
        self.shifts = rng.uniform(0, 2, size=(tables, depth, 8))
        self.weights = rng.integers(1, 1 << 62, (tables, depth, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.probes = probes

    def cells(self, units: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes) numbers of cells, a vector's own one first."""
        tables, depth = self.matrices.shape[:2]
        out = np.empty((len(units), tables, 1 + self.probes), np.uint64)
        moves = (2 * NEIGHBOURS).astype(np.int64).astype(np.uint64)
        for t in range(tables):
            own = np.zeros(len(units), np.uint64)
            near, steps = [], []
            for b in range(depth):
                x = units @ self.matrices[t, b] + self.shifts[t, b]
                point = lattice_point(x)
                weight = self.weights[t, b]
                own += ((2 * point).astype(np.int64).astype(np.uint64) * weight).sum(1, dtype=np.uint64)
                # The nearer a neighbouring point, the larger the product with the way to it.
                near.append((x - point) @ NEIGHBOURS.T)
                steps.append((moves * weight).sum(1, dtype=np.uint64))
            best = np.argsort(-np.hstack(near), axis=1, kind="stable")[:, :self.probes]
            out[:, t, 0] = own
            out[:, t, 1:] = own[:, None] + np.concatenate(steps)[best]
            out[:, t] = mix(out[:, t], t + 1)
        return out


def _units(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that the squares neither vanish nor overflow.
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled ** 2).sum(1, keepdims=True))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each label and vector; minus zero is zero."""
    for batch in batches:
        vectors = batch.column("vector")
        labels = batch.column("label").to_pylist()
        flat = vectors.flatten().to_numpy(zero_copy_only=False) + 0.0
        ends = np.r_[0, np.cumsum(np.diff(vectors.offsets.to_numpy()))]
        blobs = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        keys = [hashlib.blake2b(f"{label}:".encode() + blob, digest_size=32).digest() for label, blob in zip(labels, blobs, strict=True)]
        yield pa.record_batch({
            "id": batch.column("id"), "label": batch.column("label"), "key": pa.array(keys, pa.binary()),
            "vector": pa.array(blobs, pa.binary())})


def _visits(options: tuple, kind: type, crowd: dict[int, int] | None):
    """Rows of cells with their visitors; without ``crowd`` only the counters of the cells."""
    held: dict[int, Tables] = {}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("vector").to_pylist()
            sizes = np.array([len(b) // np.dtype(kind).itemsize for b in blobs], np.int64)
            labels = np.array(batch.column("label").to_pylist(), object)
            reps = batch.column("rep").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                tables = held.setdefault(int(size), Tables(int(size), *options))
                every = np.flatnonzero(sizes == size)
                for rows in np.array_split(every, -(-len(every) // 2048)):
                    units = _stack([blobs[r] for r in rows], kind)
                    cells = tables.cells(units)
                    salt = np.array([hash_of(f"{label}:{size}") for label in labels[rows]], np.uint64)
                    cells = mix(cells + salt[:, None, None])
                    n, per = len(rows), cells.shape[1] * cells.shape[2]
                    flat = cells.reshape(-1)
                    who = np.repeat(np.arange(n), per)
                    home = np.tile(np.arange(cells.shape[2]) == 0, n * cells.shape[1])
                    counter = (flat % np.uint64(SKETCH)).astype(np.int64)
                    if crowd is None:
                        found, counts = np.unique(counter, return_counts=True)
                        yield pa.record_batch({"counter": pa.array(found), "n": pa.array(counts)})
                        continue
                    many = np.array([crowd.get(c, 1) for c in counter.tolist()], np.int64)
                    mine = (mix(reps[rows].view(np.uint64), 5)[who] % many.astype(np.uint64)).astype(np.int64)
                    # A member of block i meets every block of its cell.
                    row = np.repeat(np.arange(len(flat)), many)
                    other = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
                    own = mine[row]
                    yield pa.record_batch({
                        "cell": pa.array(flat[row].view(np.int64)), "label": pa.array(labels[rows][who[row]], pa.string()),
                        "size": pa.array(np.full(len(row), size, np.int32)),
                        "lo": pa.array(np.minimum(own, other).astype(np.int32)),
                        "hi": pa.array(np.maximum(own, other).astype(np.int32)),
                        "block": pa.array(own.astype(np.int32)), "home": pa.array(home[row]),
                        "rep": pa.array(reps[rows][who[row]]),
                        "vector": pa.array([blobs[r] for r in rows[who[row]]], pa.binary()),
                    })
    return visit


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rest: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of equal keys in batches that are sorted by them; a run is at most a few blocks long."""
    now, held = None, {name: [] for name in rest}
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in keys]
        values = {name: batch.column(name).to_pylist() for name in rest}
        for row, key in enumerate(zip(*columns, strict=True)):
            if key != now:
                if now is not None:
                    yield now, held
                now, held = key, {name: [] for name in rest}
            for name in rest:
                held[name].append(values[name][row])
    if now is not None:
        yield now, held


def _stack(blobs: list[bytes], kind: type) -> np.ndarray:
    return _units(np.frombuffer(b"".join(blobs), kind).astype(np.float64).reshape(len(blobs), -1))


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that join whatever a symmetric matrix of links joins, at most one for each row."""
    n, out = len(near), []
    left = np.ones(n, bool)
    for first in range(n):
        if not left[first]:
            continue
        left[first], todo = False, [first]
        while todo:
            a = todo.pop()
            found = np.flatnonzero(near[a] & left)
            left[found] = False
            out += [(a, int(b)) for b in found]
            todo += found.tolist()
    return out


def _linked(cosine: float, kind: type):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[tuple[int, int]] = []
        for key, held in _groups(batches, ["cell", "label", "size", "lo", "hi"], ["rep", "home", "block", "vector"]):
            if len(held["rep"]) < 2 or not any(held["home"]):
                continue
            units, home, block = _stack(held["vector"], kind), np.array(held["home"]), np.array(held["block"])
            near = (units @ units.T >= cosine) & (home[:, None] | home[None, :])
            if key[3] != key[4]:
                near &= block[:, None] != block[None, :]
            ends += [(held["rep"][a], held["rep"][b]) for a, b in forest(near) if held["rep"][a] != held["rep"][b]]
            if len(ends) > 50_000:
                yield _pairs(ends)
                ends = []
        yield _pairs(ends)
    return link


def _pairs(ends: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = list(dict.fromkeys((min(e), max(e)) for e in ends))
    return pa.record_batch({"a": pa.array([a for a, _ in ends], pa.int64()), "b": pa.array([b for _, b in ends], pa.int64())})


def _counted(cosine: float, kind: type):
    """How many vectors, copies included, the members of a component are linked with, by pair of blocks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), held in _groups(batches, ["component", "lo", "hi"], ["rep", "block", "copies", "vector"]):
            units, block = _stack(held["vector"], kind), np.array(held["block"])
            copies = np.array(held["copies"], np.int64)
            near = units @ units.T >= cosine
            if lo != hi:
                near &= block[:, None] != block[None, :]
            np.fill_diagonal(near, False)
            yield pa.record_batch({
                "rep": pa.array(held["rep"], pa.int64()), "n": pa.array(near.astype(np.int64) @ copies, pa.int64())})
    return count


def lattice_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = 0.93, tables: int = 10, probes: int = 2, width: float = 2.0, depth: int = 1,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each id.

    Vectors of one label (not null) and one number of components link if their cosine, in double
    precision, is ``cosine`` or more. ``n_links`` counts the other vectors linked directly, copies
    included; ``component_id`` is the smallest id reached by links. ``depth`` joins that many lattice points to one cell:
    more make cells finer for very many vectors of a label, and ask for more ``tables``.

    A vector that is null, zero, or holds a null or a non-finite component links with nothing, as does one
    without a label: no links, its own component, kept. Rows without an id give no row. An id that is
    repeated gives one row; of its usable rows the one of the least label, then the least vector, counts.
    Other columns of the input are not looked at. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    on_executors(spark)
    n = shuffle_partitions(spark)
    kind = np.float64 if "double" in dict(vectors.dtypes)[vector_col] else np.float32
    as_array = f"array<{'double' if kind is np.float64 else 'float'}>"
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                         F.col(vector_col).cast(as_array).alias("vector")).where("id is not null")
    sound = own.where(F.col("label").isNotNull() & usable(F.col("vector")))
    one = sound.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.*")
    keyed = staged(one.mapInArrow(_labelled, "id long, label string, key binary, vector binary"))
    reps = staged(keyed.groupBy("key").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")))

    options = (tables, probes, width, depth)
    shown = reps.select("rep", "label", "vector")
    # At most SKETCH counters; a cell's counter is not below its number of members.
    crowded = shown.mapInArrow(_visits(options, kind, None), "counter long, n long").groupBy("counter").agg(
        F.sum("n").alias("n")).where(F.col("n") > BLOCK).collect()
    crowd = {row.counter: -(-row.n // BLOCK) for row in crowded}
    visits = shown.mapInArrow(_visits(options, kind, crowd), f"{GROUP}, block int, home boolean, rep long, vector binary")
    order = ["cell", "label", "size", "lo", "hi"]
    met = visits.repartition(n, "cell", "lo", "hi").sortWithinPartitions(*order)
    links = staged(met.mapInArrow(_linked(cosine, kind), "a long, b long").distinct())

    joined = staged(connected_components(links).withColumnRenamed("node", "rep"))
    blocks = joined.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = joined.join(blocks, "component").join(reps.select("rep", "copies", "vector"), "rep").select(
        "component", "rep", "copies", "vector", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = placed.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                          "block", "rep", "copies", "vector")
    counted = dealt.repartition(n, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "rep").mapInArrow(
        _counted(cosine, kind), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("near"))

    classes = reps.select("key", "rep", "copies").join(joined, "rep", "left").join(counted, "rep", "left").select(
        "key", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    found = keyed.select("id", "key").join(classes, "key").drop("key")
    whole = own.select("id").distinct().join(found, "id", "left")
    component = F.coalesce("component_id", "id")
    return whole.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("id") == component).alias("kept"))
