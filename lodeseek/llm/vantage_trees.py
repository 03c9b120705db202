"""Nearest neighbours by inner product from vantage-point trees, one for each shard of the vectors.

A shard holds vectors of about the same length. They get one more coordinate that brings all of them to
the same one; then the largest inner product is the smallest distance, and the triangle inequality holds.
A subtree is left when its least possible distance, times a factor, is beyond the worst one kept; factor
one is exact search. The factor is the largest that finds enough for some queries of a block, which are
also compared with the whole shard.
Query blocks meet shards in an equi-join; a block is searched in a tree as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.staging import gathered, on_executors, scattered, shuffle_partitions, staged
from lodeseek.llm.words import mix

SHARD, BLOCK, LEAF = 8192, 1024, 96
BAND = 6  # lengths within a factor of 2 ** (1 / BAND) share shards
TRIAL, ENOUGH = 32, 0.97  # queries of a block that are compared with a whole shard, and the part to be found


def usable(vector: Column) -> Column:
    """Whether a vector has no null and no non-finite component and is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The number of components, ids, and vectors of the rows that have so many."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    vectors = batch.column(1)
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), ids[rows], flat[starts[rows][:, None] + np.arange(size)]


def bands(vectors: np.ndarray) -> np.ndarray:
    """A number for each vector's length; those of a number differ by a factor of ``2 ** (1 / BAND)`` at most."""
    square = (vectors.astype(np.float64) ** 2).sum(1)
    return np.floor(BAND / 2 * np.log2(np.maximum(square, np.finfo(np.float64).tiny))).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size, _, stack in _stacks(batch):
            found, counts = np.unique(bands(stack), return_counts=True)
            yield pa.record_batch({
                "size": pa.array(np.full(len(found), size, np.int32)), "band": pa.array(found), "n": pa.array(counts)})


def _dealt(shards: dict[tuple[int, int], tuple[int, int]] | None, parts: int = 1):
    """Ids and vectors of each part: by ``shards`` the first part of a size and band and how many follow, or ``parts``."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, ids, stack in _stacks(batch):
                spread = mix(ids.view(np.uint64), 3)
                if shards is None:
                    part = (spread % np.uint64(parts)).astype(np.int32)
                else:
                    names, which = np.unique(bands(stack), return_inverse=True)
                    first, many = np.array([shards[size, int(band)] for band in names]).reshape(-1, 2)[which].T
                    part = (first + (spread % many.astype(np.uint64)).astype(np.int64)).astype(np.int32)
                found, blobs = scattered(part, {"ids": ids, "vectors": stack})
                yield pa.record_batch({
                    "size": pa.array(np.full(len(found), size, np.int32)), "part": pa.array(found, pa.int32()),
                    "key": pa.array([int(size) << 32 | int(p) for p in found], pa.int64()),
                    "ids": pa.array(blobs["ids"], pa.binary()), "vectors": pa.array(blobs["vectors"], pa.binary()),
                })
    return deal


PARTS = "size int, part int, key long, ids binary, vectors binary"


class Tree:
    """Vectors of one length in the order of the tree; a node is a range of them around a vantage point."""

    def __init__(self, lifted: np.ndarray, seed: int = 1) -> None:
        self.order = np.arange(len(lifted))
        self.nodes: dict[tuple[int, int], tuple[int, int, float]] = {}  # range -> vantage point, border, radius
        rng = np.random.default_rng(seed)
        todo = [(0, len(lifted))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= LEAF:
                continue
            rows = self.order[lo:hi]
            # Of a few points, the one whose distances to others spread most tells inside from outside best.
            trial = rng.choice(rows, 8, replace=False)
            against = lifted[rng.choice(rows, min(128, len(rows)), replace=False)]
            apart = np.linalg.norm(against[None] - lifted[trial][:, None], axis=2)
            vantage = trial[int(np.argmax(apart.std(1)))]
            far = np.linalg.norm(lifted[rows] - lifted[vantage], axis=1)
            by = np.argsort(far, kind="stable")
            middle = (lo + hi) // 2
            self.order[lo:hi] = rows[by]
            self.nodes[(lo, hi)] = (int(vantage), middle, float(far[by[middle - lo]]))
            todo += [(lo, middle), (middle, hi)]
        place = np.argsort(self.order)
        self.nodes = {key: (int(place[v]), middle, radius) for key, (v, middle, radius) in self.nodes.items()}
        self.lifted = lifted[self.order]

    def search(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Places of the ``k`` nearest found for each query, unsorted; -1 where there are fewer.

        ``queries`` are as long as the vectors, so a distance follows from the product. All queries go down to
        their own leaf first; then one walk visits a node with those that can't leave it out.
        """
        lifted, nodes, count = self.lifted, self.nodes, len(queries)
        twice = 2 * float((lifted[0] ** 2).sum()) if len(lifted) else 0.0
        best = np.full((count, k), -np.inf)
        place = np.full((count, k), -1)
        own = np.full(count, -1)

        def look(rows: np.ndarray, lo: int, hi: int) -> None:
            dots = queries[rows] @ lifted[lo:hi].T
            both = np.concatenate([best[rows], dots], 1)
            names = np.concatenate([place[rows], np.broadcast_to(np.arange(lo, hi), dots.shape)], 1)
            top = np.argpartition(both, both.shape[1] - k, axis=1)[:, -k:]
            line = np.arange(len(rows))[:, None]
            best[rows], place[rows] = both[line, top], names[line, top]

        def distance(rows: np.ndarray, vantage: int) -> np.ndarray:
            return np.sqrt(np.maximum(twice - 2 * (queries[rows] @ lifted[vantage]), 0))

        def reach(rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(twice - 2 * best[rows].min(1), 0))

        def descend(rows: np.ndarray, lo: int, hi: int) -> None:
            if not len(rows):
                return
            if (lo, hi) not in nodes:
                own[rows] = lo
                look(rows, lo, hi)
                return
            vantage, middle, radius = nodes[(lo, hi)]
            inside = distance(rows, vantage) < radius
            descend(rows[inside], lo, middle)
            descend(rows[~inside], middle, hi)

        def walk(rows: np.ndarray, lo: int, hi: int) -> None:
            if not len(rows):
                return
            if (lo, hi) not in nodes:
                rows = rows[own[rows] != lo]
                if len(rows):
                    look(rows, lo, hi)
                return
            vantage, middle, radius = nodes[(lo, hi)]
            beyond = distance(rows, vantage) - radius
            walk(rows[beyond * factor <= reach(rows)], lo, middle)
            walk(rows[-beyond * factor <= reach(rows)], middle, hi)

        if len(lifted):
            descend(np.arange(count), 0, len(lifted))
            walk(np.arange(count), 0, len(lifted))
        return place

    def within(self, queries: np.ndarray, least: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all points whose product with a query is its ``least`` or more, however many tie."""
        lifted, nodes = self.lifted, self.nodes
        twice = 2 * float((lifted[0] ** 2).sum()) if len(lifted) else 0.0
        reach = np.sqrt(np.maximum(twice - 2 * least, 0))
        who, where = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def walk(rows: np.ndarray, lo: int, hi: int) -> None:
            if not len(rows):
                return
            if (lo, hi) not in nodes:
                row, place = np.nonzero(queries[rows] @ lifted[lo:hi].T >= least[rows][:, None])
                who.append(rows[row])
                where.append(place + lo)
                return
            vantage, middle, radius = nodes[(lo, hi)]
            beyond = np.sqrt(np.maximum(twice - 2 * (queries[rows] @ lifted[vantage]), 0)) - radius
            walk(rows[beyond * factor <= reach[rows]], lo, middle)
            walk(rows[-beyond * factor <= reach[rows]], middle, hi)

        if len(lifted):
            walk(np.arange(len(queries)), 0, len(lifted))
        who, where = np.concatenate(who), np.concatenate(where)
        order = np.argsort(who, kind="stable")
        return who[order], where[order]


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with a coordinate that makes each ``longest`` long."""
    square = (vectors ** 2).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(longest ** 2 - square, 0))[:, None]], 1)


def kept_factor(tree: Tree, queries: np.ndarray, k: int, most: float) -> float:
    """The largest factor of ``most`` and less that finds ``ENOUGH`` of what some of the queries should find."""
    some = queries[:: max(1, len(queries) // TRIAL)][:TRIAL]
    dots = some @ tree.lifted.T
    last = np.partition(dots, -k, axis=1)[:, -k]
    last -= 1e-9 * np.abs(last)
    line = np.arange(len(some))[:, None]
    factor = most
    while factor > 1:
        place = tree.search(some, k, factor)
        if ((dots[line, place] >= last[:, None]) & (place >= 0)).mean() >= ENOUGH:
            return factor
        factor = 1 + (factor - 1) / 2 if factor > 1.2 else 1.0
    return min(most, 1.0)


def inner_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, the products summed from the first to the last."""
    total = np.zeros(len(vectors))
    for k in range(len(query)):
        total += vectors[:, k] * query[k]
    return total


def _planted(kind: type, k: int):
    """The tree of each shard, with the ids of equal vectors together."""
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in gathered(batches, "key", {"ids": np.int64, "vectors": kind}):
            ids = held["ids"]
            vectors = held["vectors"].reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
            known: dict[bytes, list[int]] = {}
            for row, vector in enumerate(vectors):
                known.setdefault((vector + 0.0).tobytes(), []).append(row)
            firsts = np.array([rows[0] for rows in known.values()])
            points = vectors[firsts].astype(np.float64)
            longest = float(np.sqrt((points ** 2).sum(1).max()))
            tree = Tree(lift(points, longest))
            # A query needs the k smallest ids of equal vectors, besides its own.
            own = [np.unique(ids[rows])[: k + 1] for rows in known.values()]
            own = [own[t] for t in tree.order]
            ranges = np.array([(*key, vantage, middle) for key, (vantage, middle, _) in tree.nodes.items()], np.int64)
            yield pa.record_batch({
                "size": pa.array([key >> 32], pa.int32()), "shard": pa.array([key & 0xFFFFFFFF], pa.int32()),
                "points": pa.array([vectors[firsts[tree.order]].tobytes()], pa.binary()),
                "ids": pa.array([np.concatenate(own).tobytes()], pa.binary()),
                "counts": pa.array([np.array([len(o) for o in own], np.int64).tobytes()], pa.binary()),
                "ranges": pa.array([ranges.tobytes()], pa.binary()),
                "radii": pa.array([np.array([radius for _, _, radius in tree.nodes.values()]).tobytes()], pa.binary()),
                "longest": pa.array([longest], pa.float64()),
            })
    return plant


TREES = "size int, shard int, points binary, ids binary, counts binary, ranges binary, radii binary, longest double"


def _found(kind: type, k: int, factor: float):
    """The nearest found of each query block in each shard, with exact scores."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, as_, r=row, b=batch: np.frombuffer(b.column(name)[r].as_py(), as_)
                size = batch.column("size")[row].as_py()
                points = get("points", kind).reshape(-1, size).astype(np.float64)
                counts, ids = get("counts", np.int64), get("ids", np.int64)
                at = np.r_[0, np.cumsum(counts)]
                query_ids = get("query_ids", np.int64)
                queries = get("query_vectors", kind).reshape(-1, size).astype(np.float64)
                longest = batch.column("longest")[row].as_py()
                tree = Tree.__new__(Tree)
                tree.lifted = lift(points, longest)
                tree.nodes = {
                    (int(lo), int(hi)): (int(vantage), int(middle), float(radius))
                    for (lo, hi, vantage, middle), radius in zip(
                        get("ranges", np.int64).reshape(-1, 4), get("radii", np.float64), strict=True)
                }
                scaled = queries * (longest / np.linalg.norm(queries, axis=1))[:, None]
                raised = np.concatenate([scaled, np.zeros((len(scaled), 1))], 1)
                # One more than k, as a query may find itself; then all that tie with the last of them.
                wanted = min(k + 1, max(1, len(points)))
                own_factor = kept_factor(tree, raised, wanted, factor)
                place = tree.search(raised, wanted, own_factor)
                dots = np.einsum("qd,qkd->qk", raised, tree.lifted[place])
                least = np.where((place >= 0).all(1), np.where(place >= 0, dots, np.inf).min(1), -np.inf)
                who, where = tree.within(raised, least - 1e-9 * np.maximum(longest ** 2, np.abs(least)), own_factor)
                bounds = np.searchsorted(who, np.arange(len(queries) + 1))
                out_q, out_v, out_s = [], [], []
                for q in range(len(queries)):
                    places = np.union1d(where[bounds[q]:bounds[q + 1]], place[q][place[q] >= 0])
                    exact = inner_products(points[places], queries[q])
                    names = np.concatenate([ids[at[p]:at[p + 1]] for p in places])
                    scores = np.repeat(exact, counts[places])
                    keep = names != query_ids[q]
                    names, scores = names[keep], scores[keep]
                    best = np.lexsort((names, -scores))[:k]
                    out_q.append(np.full(len(best), query_ids[q]))
                    out_v.append(names[best])
                    out_s.append(scores[best])
                yield pa.record_batch({
                    "query_id": pa.array(np.concatenate(out_q)), "vec_id": pa.array(np.concatenate(out_v)),
                    "score": pa.array(np.concatenate(out_s)),
                })
    return find


def nearest(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    factor: float = 1.0,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of largest inner product found for each query.

    Both tables have ``id_col`` (an integer) and ``vector_col`` (floats or doubles, the same kind). A query's own id is no result
    of it. Nearest come first, ties go to the smaller id. Vectors that are null, zero, or hold a null or a
    non-finite component take no part, nor do rows without an id; a vector is compared with those of its length
    only. A repeated row counts once, an id with several vectors once for each. Without vectors or queries the result is empty.
    ``factor`` is the largest that may be taken; where it finds too little for some queries of a block in a shard, a
    smaller one is, down to exact search.
    """
    spark = vectors.sparkSession
    on_executors(spark)
    n = shuffle_partitions(spark)
    kind = np.float64 if "double" in dict(vectors.dtypes)[vector_col] else np.float32
    as_array = f"array<{'double' if kind is np.float64 else 'float'}>"

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(as_array).alias("vector"))
        return rows.where(F.col("id").isNotNull() & usable(F.col("vector")))

    known = clean(vectors)
    shards: dict[tuple[int, int], tuple[int, int]] = {}
    many = 0
    for row in known.mapInArrow(_counted, "size int, band long, n long").groupBy("size", "band").agg(
            F.sum("n").alias("n")).orderBy("size", "band").collect():
        shards[row.size, row.band] = (many, -(-row.n // SHARD))
        many += -(-row.n // SHARD)
    blocks = max(1, -(-clean(queries).count() // BLOCK))

    def packed(rows: DataFrame, dealt, parts: int) -> DataFrame:
        return rows.mapInArrow(dealt, PARTS).repartition(min(n, parts), "key").sortWithinPartitions("key")

    trees = staged(packed(known, _dealt(shards), max(1, many)).mapInArrow(_planted(kind, k), TREES))

    def joined_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in gathered(batches, "key", {"ids": np.int64, "vectors": kind}):
            yield pa.record_batch({
                "size": pa.array([key >> 32], pa.int32()), "block": pa.array([key & 0xFFFFFFFF], pa.int32()),
                "query_ids": pa.array([held["ids"].tobytes()], pa.binary()),
                "query_vectors": pa.array([held["vectors"].tobytes()], pa.binary()),
            })

    asked = staged(packed(clean(queries), _dealt(None, blocks), blocks).mapInArrow(
        joined_blobs, "size int, block int, query_ids binary, query_vectors binary"))
    pairs = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(
        min(8 * n, max(1, many) * blocks), "shard", "block").join(asked.hint("shuffle_hash"), ["size", "block"])
    best = pairs.mapInArrow(_found(kind, k, factor), "query_id long, vec_id long, score double").distinct()
    ranked = best.selectExpr(
        "query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
