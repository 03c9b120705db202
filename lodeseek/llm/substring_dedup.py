"""Removal of word passages that already stand earlier in a collection.

Anchors are short runs of words at the places of a difference cover: modulo the period, any two
places have a shift below the period that takes both to cover places. So two equal windows share an
anchor at the same distance from their starts, though only a part of all places is hashed. Anchors
that occur once go; around the others the run is extended to whole windows, whose first
occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.staging import gathered, long_array, on_executors, scattered, shuffle_partitions, slices, staged
from lodeseek.llm.words import Words, mix, run_places, runs

# Perfect difference sets: each residue is the difference of two of the places. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
SLICE = 12 << 20
RESULTS = 2_000_000  # places that a task holds before it sends them on


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of five words or more, and its places."""
    period = max([p for p in COVERS if window - p + 1 >= 5], default=1)
    return period, COVERS[period]


def _within(at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each place of the batch, and the place inside it."""
    doc = np.searchsorted(at, places, "right") - 1
    return doc, places - at[doc]


def _first_of_each(keys: list[np.ndarray], docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first occurrence of each key, and of those that come later."""
    order = np.lexsort((places, docs, *reversed(keys)))
    changed = np.zeros(len(order), bool)
    if len(order):
        changed[0] = True
    for key in keys:
        changed[1:] |= key[order][1:] != key[order][:-1]
    group = np.cumsum(changed) - 1
    head = order[changed][group] if len(order) else order
    later = (docs[order] != docs[head]) | (places[order] != places[head])
    return order[changed], order[later]


def _blobs(part: np.ndarray, columns: dict[str, np.ndarray], names: tuple[str, ...]) -> pa.RecordBatch:
    found, blobs = scattered(part, columns)
    none = pa.nulls(len(found), pa.binary())
    return pa.record_batch({
        "part": pa.array(found, pa.int32()),
        **{n: pa.array(blobs[n], pa.binary()) if n in blobs else none.fill_null(b"") for n in names},
    })


NAMES = ("keys", "more", "docs", "places")
BLOBS = "part int, keys binary, more binary, docs binary, places binary"


def _by_document(docs: np.ndarray, parts: int) -> np.ndarray:
    """Where results of a document go: a negative part, as they need no more comparison."""
    return (-1 - (mix(docs.view(np.uint64), 5) % np.uint64(parts)).astype(np.int64)).astype(np.int32)


def _anchors(window: int, parts: int):
    """One row per distinct anchor of a slice, and the occurrences of those repeated inside the slice as hits."""
    period, cover = cover_for(window)
    size = window - period + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            ids, _ = long_array(batch.column(0))
            words = Words(batch.column(1))
            places = run_places(words.at, size)
            doc, inside = _within(words.at, places)
            chosen = np.isin(inside % period, cover) & (np.diff(words.at)[doc] >= window)
            places, doc, inside = places[chosen], doc[chosen], inside[chosen].astype(np.uint32)
            if not len(places):
                continue
            keys = runs(words.hashes(), size)[places]
            docs = ids[doc]
            _, first, group, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            here = times[group] > 1
            yield _blobs((keys[first] % np.uint64(parts)).astype(np.int32), {
                "keys": (keys[first] >> np.uint64(32)).astype(np.uint32), "docs": docs[first], "places": inside[first],
            }, NAMES)
            if here.any():
                yield _blobs(_by_document(docs[here], max(1, parts // 4)), {"docs": docs[here], "places": inside[here]}, NAMES)
    return deal


def _sent_on(results: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Documents and places by document, those of many parts together: a row for each task and target."""
    docs, places, held = [], [], 0
    for some, at in results:
        docs.append(some)
        places.append(at)
        held += len(some)
        if held >= RESULTS:
            doc = np.concatenate(docs)
            yield _blobs(_by_document(doc, parts), {"docs": doc, "places": np.concatenate(places)}, NAMES)
            docs, places, held = [], [], 0
    if held:
        doc = np.concatenate(docs)
        yield _blobs(_by_document(doc, parts), {"docs": doc, "places": np.concatenate(places)}, NAMES)


def _repeated(parts: int):
    """Occurrences of anchors that occur more than once."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kinds = {"keys": np.uint32, "docs": np.int64, "places": np.uint32}
        for part, held in gathered(batches, "part", kinds):
            docs, places = held["docs"], held["places"]
            if part >= 0:
                order = np.argsort(held["keys"], kind="stable")
                keys, docs, places = held["keys"][order], docs[order], places[order]
                same = keys[1:] == keys[:-1]
                keep = np.r_[False, same] | np.r_[same, False]
                docs, places = docs[keep], places[keep]
            yield docs, places
    return lambda batches: _sent_on(found(batches), parts)


def _later(parts: int):
    """Windows whose words start earlier elsewhere."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kinds = {"keys": np.uint64, "more": np.uint32, "docs": np.int64, "places": np.uint32}
        for part, held in gathered(batches, "part", kinds):
            docs, places = held["docs"], held["places"]
            if part >= 0:
                _, later = _first_of_each([held["keys"], held["more"]], docs, places)
                docs, places = docs[later], places[later]
            yield docs, places
    return lambda batches: _sent_on(found(batches), parts)


def _each_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with its places in ascending order."""
    for _, held in gathered(batches, "part", {"docs": np.int64, "places": np.uint32}):
        order = np.lexsort((held["places"], held["docs"]))
        docs, places = held["docs"][order], held["places"][order]
        if not len(docs):
            continue
        firsts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        bounds = np.r_[firsts, len(docs)]
        for lo in range(0, len(firsts), 1000):
            some = range(lo, min(lo + 1000, len(firsts)))
            yield pa.record_batch({
                "found_id": pa.array(docs[firsts[lo:lo + 1000]]),
                "places": pa.array([places[bounds[k]:bounds[k + 1]].tobytes() for k in some], pa.binary()),
            })


def _marked(at: np.ndarray, blobs: pa.Array, before: int, after: int) -> np.ndarray:
    """Which words stand from ``before`` words ahead of a place of their text to ``after`` words behind it."""
    change = np.zeros(at[-1] + 1, np.int64)
    for d, blob in enumerate(blobs.to_pylist()):
        if blob:
            places = np.unique(np.frombuffer(blob, np.uint32)).astype(np.int64)
            places = places[places < at[d + 1] - at[d]]
            np.add.at(change, at[d] + np.maximum(places - before, 0), 1)
            np.add.at(change, np.minimum(at[d] + places + after + 1, at[d + 1]), -1)
    return np.cumsum(change[:-1]) > 0


def _windows(window: int, parts: int):
    """Anchors extended to windows: one row per distinct window of a slice, later ones as results."""
    period, _ = cover_for(window)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            ids, _ = long_array(batch.column(0))
            words = Words(batch.column(1))
            near = _marked(words.at, batch.column(2), period - 1, 0)
            places = run_places(words.at, window)
            places = places[near[places]]
            if not len(places):
                continue
            hashes = words.hashes()
            keys = runs(hashes, window)[places]
            more = (runs(mix(hashes, 77), window)[places] >> np.uint64(32)).astype(np.uint32)
            doc, inside = _within(words.at, places)
            docs, inside = ids[doc], inside.astype(np.uint32)
            first, later = _first_of_each([keys, more], docs, inside)
            yield _blobs((keys[first] % np.uint64(parts)).astype(np.int32), {
                "keys": keys[first], "more": more[first], "docs": docs[first], "places": inside[first],
            }, NAMES)
            if len(later):
                yield _blobs(_by_document(docs[later], max(1, parts // 4)), {"docs": docs[later], "places": inside[later]}, NAMES)
    return deal


def kept_text(words: Words, gone: np.ndarray) -> list[str]:
    """Each text's words that are not ``gone``, joined by one space."""
    kept = ~gone
    starts, ends = words.starts[kept], words.ends[kept]
    change = np.zeros(len(words.data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    take = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    doc = np.searchsorted(words.at, np.flatnonzero(kept), "right") - 1
    not_first = np.r_[False, doc[1:] == doc[:-1]] if len(doc) else np.empty(0, bool)
    data = words.data.copy()
    data[starts[not_first] - 1] = 32
    take[starts[not_first] - 1] = True
    out = data[take].tobytes()
    bounds = np.r_[0, np.cumsum(take)][words.offsets]
    return [out[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _cleaned(window: int, text_at: int, width: int):
    """Rows with the words of their later windows taken out."""
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{text_at}"):
            words = Words(batch.column(text_at))
            gone = _marked(words.at, batch.column(width), 0, window - 1)
            columns = [batch.column(k) for k in range(width)]
            there = columns[text_at].is_valid().to_numpy(zero_copy_only=False)
            columns[text_at] = pa.array(kept_text(words, gone), pa.string(), mask=~there)
            removed = np.diff(np.r_[0, np.cumsum(gone)][words.at])
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.diff(words.at)), pa.array(removed)],
                [f"c{k}" for k in range(width)] + ["n_words", "n_removed"],
            )
    return clean


def substring_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
) -> DataFrame:
    """``df`` with repeated passages removed from ``text_col``, and ``n_words``, ``n_removed`` (long).

    A word goes if it lies in ``window`` consecutive words of its text that also start earlier in the
    collection: in a text of a smaller id, or earlier in the same text. Windows are judged on the
    input. Kept words are joined by one space. A null text stays null with 0 words; a
    row without an id stays whole and repeats nothing. Rows that repeat an id share their places: what
    goes at a place of one goes at that place of all. All columns stay; ``n_words`` and ``n_removed`` of
    ``df`` are replaced. An empty table gives an empty one.

    A key that is frequent everywhere sends one row from each slice of input to its task, since the
    occurrences after the first of a slice are settled there.
    """
    spark = df.sparkSession
    on_executors(spark)
    n = shuffle_partitions(spark)
    parts = 4 * n
    df = df.drop(*[c for c in ("n_words", "n_removed") if c not in (id_col, text_col)])
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).where("doc_id is not null and text is not null")

    def met(rows: DataFrame, meet) -> DataFrame:
        seen = rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(meet, BLOBS)
        return staged(seen.repartition(n, "part").sortWithinPartitions("part").mapInArrow(
            _each_document, "found_id long, places binary"))

    hits = met(docs.mapInArrow(_anchors(window, parts), BLOBS), _repeated(n))
    near = docs.join(hits, docs.doc_id == hits.found_id).select("doc_id", "text", "places")
    later = met(near.mapInArrow(_windows(window, parts), BLOBS), _later(n))

    columns, text_at = df.columns, df.columns.index(text_col)
    plain = df.toDF(*[f"c{k}" for k in range(len(columns))])
    key = F.col(f"c{columns.index(id_col)}").cast("long")
    joined = plain.where(key.isNotNull()).join(later, key == F.col("found_id"), "left").drop("found_id").union(
        plain.where(key.isNull()).withColumn("places", F.lit(None).cast("binary")))
    joined = joined.withColumn(f"c{text_at}", F.col(f"c{text_at}").cast("string"))
    schema = ", ".join(f"{c} {t}" for c, t in joined.dtypes if c != "places") + ", n_words long, n_removed long"
    cleaned = joined.mapInArrow(_cleaned(window, text_at, len(columns)), schema)
    return cleaned.toDF(*columns, "n_words", "n_removed")
