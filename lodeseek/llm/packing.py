"""Token sequences of bounded length, packed by best fit in bulk-synchronous supersteps.

Documents (cut into pieces only where they are too long) are range-sorted by length. A piece longer than half
a sequence opens one. The others follow in bands of lengths, long ones first, and a band in supersteps, each of which

1. range-sorts the gaps that sequences have left; one may count as several places, if it surely holds them;
2. sweeps pieces and places from long to short: a piece is matched as long as a place is left that holds it, so the
   longest ones are; then from short to long: each matched piece takes the smallest place that holds it, and where
   several want the same, the one of the lowest rank gets it and the others move on to the next ones;
3. joins pieces and places, writes where the pieces are and what is left of the gaps, and begins again.

New sequences are opened when the longest piece left fits nowhere, as many as the pieces left need at least.
Lengths and gaps are whole numbers up to ``max_tokens``, so a sweep is running sums and maxima of as many classes,
which a superstep's plan holds as constants; pieces and gaps themselves are rows that are sorted, ranked and joined by Spark.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.llm.staging import on_executors, slices, staged
from lodeseek.llm.tokenizing import encoder, sent

SHORT = 8  # lengths up to here are one band

IDS = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _pieces(name: str, whole: str, max_tokens: int, end_id: int, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, whole).ids
        for batch in slices(batches, "text", 4 << 20):
            docs, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = memoryview(encode(text or "") + end)
                n = len(raw) // 4
                first = (n - 1) % max_tokens + 1
                lo, hi, number = 0, first, 0
                while lo < n:
                    part = raw[4 * lo:4 * hi]
                    docs.append(doc)
                    pieces.append(number)
                    starts.append(lo)
                    lengths.append(hi - lo)
                    sums.append(zlib.crc32(part))
                    ids.append(bytes(part) if with_ids else None)
                    lo, hi, number = hi, hi + max_tokens, number + 1
            yield pa.record_batch({
                "doc_id": pa.array(docs, pa.int64()), "piece": pa.array(pieces, pa.int32()),
                "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()), "ids": pa.array(ids, pa.binary()),
            })
    return cut


def token_pieces(
    df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024,
    end_id: int = 2, with_ids: bool = True, whole_path: str | None = None,
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids`` of each piece of each row.

    A text's ids are those of the byte-level BPE in ``ranks_path``, then ``end_id``; a null or empty text
    has ``end_id`` alone. A text of more than ``max_tokens`` ids is cut into pieces of that many, the
    first one being what is left over. ``ids`` holds little-endian 32-bit ids (null unless ``with_ids``).
    ``whole_path`` is the same vocabulary for the library that encodes texts with very long runs of white
    space; unless given, the ``.json`` file beside ``ranks_path``.
    """
    spark = df.sparkSession
    on_executors(spark)
    name, whole = sent(spark, ranks_path), sent(spark, whole_path or f"{os.path.splitext(ranks_path)[0]}.json")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_pieces(name, whole, max_tokens, end_id, with_ids), IDS)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit one by one, from numbers of pieces alone: what ``pack`` is measured by.

    Matches of length classes with sequences: ``length, rank, rank_end, sequence, offset, each``.

    Pieces of ranks from ``rank`` on go to the sequences from ``sequence`` on, ``each`` to a sequence, one
    after the other from ``offset``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences that have it
    sizes: list[int] = []  # gaps that occur, ascending
    matches, opened = [], 0

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((sequence, count))

    def fill(length: int, rank: int, left: int, gap: int, sequence: int, count: int) -> tuple[int, int]:
        """Puts pieces into sequences of one gap; pieces and sequences used."""
        each = gap // length
        whole = min(count, left // each)
        if whole:
            matches.append((length, rank, rank + whole * each, sequence, capacity - gap, each))
            leave(gap - each * length, sequence, whole)
        placed, rest = whole * each, left - whole * each
        if whole < count and rest:  # fewer pieces are left than one more sequence takes
            rest = min(rest, each)
            matches.append((length, rank + placed, rank + placed + rest, sequence + whole, capacity - gap, each))
            leave(gap - rest * length, sequence + whole, 1)
            return placed + rest, whole + 1
        return placed, whole

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect_left(sizes, length)) < len(sizes):
            gap = sizes[at]
            sequence, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            placed, used = fill(length, rank, left, gap, sequence, count)
            leave(gap, sequence + used, count - used)
            rank, left = rank + placed, left - placed
        if left:
            fresh = -(-left // (capacity // length))
            fill(length, rank, left, capacity, opened, fresh)
            opened += fresh
    return matches


def _ranked(df: DataFrame, keys: list[str], row: str) -> tuple[DataFrame, dict[int, int]]:
    """``df`` range-sorted by ``keys`` with ``row``, unique, and ``place``, the rank among equal values of the first key.

    Also the number of rows of each value. What the driver holds has a row for each value and each range.
    """
    value = keys[0]
    held = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(row, F.monotonically_increasing_id()))
    slice_of, at = F.shiftright(row, 33), F.col(row).bitwiseAND((1 << 33) - 1)
    table = held.groupBy(slice_of.alias("slice"), value).agg(
        F.count("*").alias("n"), F.min(at).alias("first")).toPandas().sort_values(["slice", value], ignore_index=True)
    table["base"] = table.groupby(value).n.cumsum() - table.n - table["first"]
    bases = _small(df.sparkSession, **{"slice": table["slice"], value: table[value], "base": table.base})
    ranked = held.withColumn("slice", slice_of).join(F.broadcast(bases), ["slice", value])
    counts = table.groupby(value).n.sum()
    return ranked.withColumn("place", at + F.col("base")).drop("slice", "base"), {int(k): int(v) for k, v in counts.items()}


def _small(spark: SparkSession, **columns: Sequence[int] | np.ndarray) -> DataFrame:
    """A table of whole numbers that the driver knows."""
    arrays = {name: pa.array(np.asarray(values, np.int64)) for name, values in columns.items()}
    return spark.createDataFrame(pa.table(arrays), ", ".join(f"`{name}` long" for name in arrays))


def _of_class(numbers: np.ndarray, index: Column) -> Column:
    """A number that the driver knows for each class: a constant of the plan, which needs no broadcast and no join."""
    return F.get(F.split(F.lit(" ".join(map(str, numbers.tolist()))), " ").cast("array<long>"), index.cast("int"))


@dataclass(frozen=True)
class Sweep:
    """How many pieces of each length find a place, and which: the k-th of a length has place ``first`` + k."""

    matched: np.ndarray
    first: np.ndarray
    slots: np.ndarray  # of each gap value: places of one gap
    slot_base: np.ndarray  # and the number of its first place

    @property
    def last(self) -> int:
        return int((self.first + self.matched)[self.matched > 0].max()) - 1


def sweep(lengths: np.ndarray, left: np.ndarray, values: np.ndarray, counts: np.ndarray) -> Sweep:
    """Matches classes of pieces (ascending lengths) with classes of gaps (ascending values)."""
    slots = np.maximum(1, values // lengths[-1])
    ends = np.cumsum(counts * slots)
    base = np.r_[0, ends]
    smaller = base[np.searchsorted(values, lengths)]  # places that are too small
    # Long to short: pieces so far, less the places that hold them, are the ones that find none.
    over = np.cumsum(left[::-1]) - (base[-1] - smaller[::-1])
    without = np.maximum(np.maximum.accumulate(over), 0)
    matched = left - np.diff(np.r_[0, without])[::-1]
    # Short to long: a rank's place is not before the first that holds it, nor before the one after its forerunner's.
    rank = np.cumsum(matched) - matched
    moved = np.maximum.accumulate(np.where(matched > 0, smaller - rank, 0))
    return Sweep(matched, rank + moved, slots, base[:-1])


def needed(lengths: np.ndarray, left: np.ndarray, values: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """New sequences for pieces that are left: none while the longest has a place, else as many as they need at least."""
    if len(values) and values[-1] >= lengths[-1]:
        return 0
    shortest = lengths[0]
    tokens = int((lengths * left).sum()) - int((values * counts).sum())
    pieces = int(left.sum()) - int((values // shortest * counts).sum())
    return max(1, -(-tokens // capacity), -(-pieces // int(capacity // shortest)))


def pack(pieces: DataFrame, max_tokens: int = 1024, ratio: float = 2.0) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (long), packed into few sequences of ``max_tokens``.

    ``pieces`` has ``doc_id``, ``piece`` and ``length`` from 1 to ``max_tokens`` (others, null included, raise
    ``ValueError``); columns ``sequence_id`` and ``offset`` that it has are replaced, others carried along. Each
    sequence is filled from 0 without gaps. Ties of length go by ``doc_id`` and ``piece``; rows that are alike take
    any order. No pieces, no sequences. A band reaches from a length down to a ``ratio``-th of it: narrower bands
    need more supersteps and come nearer to packing one by one.

    The driver holds numbers of pieces and gaps by value and range (ranges + ``max_tokens`` rows).
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    row = next(name for k in range(len(pieces.columns) + 1) if (name := f"row{k}") not in pieces.columns)
    whole = staged(pieces.withColumn(row, F.monotonically_increasing_id()))
    ranked, counts = _ranked(whole.select(F.col("length").cast("long").alias("length"), "doc_id", "piece", F.col(row).alias("id")),
                             ["length", "doc_id", "piece"], "at")
    if any(not 1 <= n <= max_tokens for n in counts) or sum(counts.values()) != whole.count():
        raise ValueError(f"a piece is empty or longer than {max_tokens}")
    items = staged(ranked.select("id", "length", "place"))
    done = np.zeros(max_tokens + 1, np.int64)
    total = np.array([counts.get(n, 0) for n in range(max_tokens + 1)], np.int64)
    half = max_tokens // 2
    opened = np.cumsum(total * (np.arange(max_tokens + 1) > half)) - total
    start = _of_class(opened[half + 1:], F.col("length") - (half + 1))
    alone = items.filter(F.col("length") > half).select(
        "id", (start + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "length")
    placed = [alone.drop("length")]
    gaps = alone.filter(F.col("length") < max_tokens).select("sequence_id", (max_tokens - F.col("length")).alias("gap"))
    used, high = int(total[half + 1:].sum()), half
    while high > 0:
        low = int(high / ratio) if high > SHORT else 0
        while (lengths := low + 1 + np.flatnonzero((total - done)[low + 1:high + 1])).size:
            left = (total - done)[lengths]
            ordered, widths = _ranked(gaps, ["gap", "sequence_id"], "at")
            values = np.array(sorted(v for v in widths if v >= lengths[0]), np.int64)
            numbers = np.array([widths[v] for v in values.tolist()], np.int64)
            fresh = needed(lengths, left, values, numbers, max_tokens)
            if fresh:
                new = spark.range(used, used + fresh).select(
                    F.col("id").alias("sequence_id"), F.lit(max_tokens).cast("long").alias("gap"), (F.col("id") - used).alias("place"))
                ordered = ordered.select(new.columns).union(new)
                values, numbers, used = np.r_[values, max_tokens], np.r_[numbers, fresh], used + fresh
            found = sweep(lengths, left, values, numbers)
            shortest, longest = int(lengths[0]), int(lengths[-1])
            each, base = np.zeros((2, int(values[-1]) - shortest + 1), np.int64)
            each[values - shortest], base[values - shortest] = found.slots, found.slot_base
            gap = F.col("gap") - shortest
            places = ordered.filter(F.col("gap") >= shortest).withColumn("slots", _of_class(each, gap))
            places = places.withColumn("first", _of_class(base, gap) + F.col("place") * F.col("slots"))
            last = F.greatest("first", F.least(F.col("first") + F.col("slots") - 1, F.lit(found.last)))
            slots = places.select("sequence_id", "gap", "first", F.explode(F.sequence("first", last)).alias("slot"))
            matched, offset = np.zeros((2, longest - shortest + 1), np.int64)
            matched[lengths - shortest], offset[lengths - shortest] = found.matched, found.first
            length = F.col("length") - shortest
            takers = items.filter(F.col("length").between(shortest, longest)).withColumn(
                "turn", F.col("place") - _of_class(done[shortest:longest + 1], length))
            takers = takers.filter((F.col("turn") >= 0) & (F.col("turn") < _of_class(matched, length))).select(
                "id", "length", (_of_class(offset, length) + F.col("turn")).alias("slot"))
            # At most ``slots`` rows of a sequence.
            mine = Window.partitionBy("sequence_id")
            size = F.coalesce("length", F.lit(0))
            step = staged(slots.join(takers, "slot", "left").select(
                "sequence_id", "id", (F.col("slot") == F.col("first")).alias("one"),
                (max_tokens - F.col("gap") + F.sum(size).over(mine.orderBy("slot")) - size).alias("offset"),
                (F.col("gap") - F.sum(size).over(mine)).alias("gap")))
            placed.append(step.filter("id is not null").select("id", "sequence_id", "offset"))
            kept = ordered.filter(F.col("gap") < shortest).select("sequence_id", "gap")
            gaps = step.filter(F.col("one") & F.col("gap").between(1, max_tokens - 1)).select("sequence_id", "gap").union(kept)
            done[lengths] += found.matched
        high = low
    where = reduce(DataFrame.union, placed).withColumnRenamed("id", row)
    return whole.join(where, row).select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and the ``ids`` (little-endian 32-bit) of each sequence, from pieces with their ids."""
    return packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    ).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
