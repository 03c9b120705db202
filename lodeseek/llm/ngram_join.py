"""Near-duplicate documents by an exact Jaccard join of word n-gram sets.

Sets are put in one global order, rare n-grams first, and stored in prefix trees. Two sets of the
wanted similarity share an n-gram among the first ones of each (its prefix), so sets meet in groups
by a prefix n-gram. A group's sets form a trie; each probe walks it once, shares the overlap counted
on a path among all sets below, and leaves a subtree when its remaining length can't reach the
wanted similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.components import connected_components
from lodeseek.llm.staging import gathered, long_array, on_executors, scattered, shuffle_partitions, slices, staged
from lodeseek.llm.words import Words, mix, run_places, runs, whole_run

HEAVY = 50_000  # n-grams that make up this share of all or more are ordered last; so many at most
MAPS = 5_000  # bit maps of a group that are compared in one task, twice as many at most
BLOCK = 1_000  # the same for sets
_TOP = np.uint64(1 << 63)


def ngram_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, ascending, as one array of 63-bit numbers and its bounds."""
    words = Words(batch.column(1))
    hashes = words.hashes(folded=True)
    places = run_places(words.at, width)
    grams = runs(hashes, width)[places] >> np.uint64(1) if len(places) else np.empty(0, np.uint64)
    counts = np.diff(words.at)
    ends = np.cumsum(np.maximum(counts - width + 1, 0))
    sets, lo = [], 0
    for d, hi in enumerate(ends):
        if hi > lo:
            sets.append(np.unique(grams[lo:hi]))
        elif counts[d]:
            sets.append(np.array([whole_run(hashes[words.at[d]:words.at[d + 1]]) >> 1], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
        lo = hi
    return np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])]


def _digests(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each set; equal sets have equal ones."""
    out = []
    for seed in (11, 29):
        total = np.r_[np.uint64(0), np.cumsum(mix(values, seed), dtype=np.uint64)]
        out.append(mix(total[at[1:]] - total[at[:-1]], seed).view(np.int64))
    return out[0], out[1]


def parity_bits(values: np.ndarray) -> bytes:
    """A bit for each remainder of the n-grams, set where an odd number has it.

    Two such maps differ in at most as many bits as the sets have n-grams that are not common. The
    length, a power of two of at least the set's size, halves by folding.
    """
    bits = max(64, 1 << int(len(values) - 1).bit_length()) if len(values) else 64
    counts = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def _measured(width: int):
    """A row for each document, and the n-grams that are frequent within a record batch."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            ids, there = long_array(batch.column(0))
            values, at = ngram_sets(batch, width)
            d1, d2 = _digests(values, at)
            n = np.diff(at)
            linked = there & (n > 0)
            yield pa.record_batch({
                "doc_id": pa.array(ids, mask=~there), "n": pa.array(n), "d1": pa.array(d1, mask=~linked),
                "d2": pa.array(d2, mask=~linked), "bits": pa.array(
                    [parity_bits(values[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)],
                    pa.binary()),
                "gram": pa.nulls(len(ids), pa.int64()), "times": pa.nulls(len(ids), pa.int64()),
            })
            grams, times = np.unique(values, return_counts=True)
            keep = times >= max(3, len(values) // (2 * HEAVY))
            k = int(keep.sum())
            yield pa.record_batch({
                "doc_id": pa.nulls(k, pa.int64()), "n": pa.nulls(k, pa.int64()), "d1": pa.nulls(k, pa.int64()),
                "d2": pa.nulls(k, pa.int64()), "bits": pa.nulls(k, pa.binary()), "gram": pa.array(grams[keep].view(np.int64)),
                "times": pa.array(times[keep]),
            })
    return measure


def _ordered(values: np.ndarray, at: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Each set in the global order: rare n-grams by number, then the frequent ones by their rank."""
    if len(heavy) and len(values):
        place = np.minimum(np.searchsorted(heavy, values), len(heavy) - 1)
        found = heavy[place] == values
        values = np.where(found, _TOP | rank[place].astype(np.uint64), values)
        for d in np.unique(np.searchsorted(at, np.flatnonzero(found), "right") - 1):
            values[at[d]:at[d + 1]].sort()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _prefixes(width: int, percent: int, parts: int, heavy):
    """The prefix of each set, dealt out by its n-grams."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_known, rank = heavy.value
        for batch in slices(batches, "text", 2 << 20):
            ids, there = long_array(batch.column(0))
            values, at = ngram_sets(batch, width)
            node, _ = _digests(values, at)
            seen, firsts, sizes, nodes = set(), [], [], []
            for d, s in enumerate(_ordered(values, at, grams_known, rank)):
                if not there[d] or not len(s) or int(node[d]) in seen:
                    continue
                seen.add(int(node[d]))
                first = s[: len(s) - -(-percent * len(s) // 100) + 1]
                firsts.append(first)
                sizes.append(np.full(len(first), min(len(s), 0xFFFFFFFF), np.uint32))
                nodes.append(np.full(len(first), node[d], np.int64))
            if not firsts:
                continue
            first, size, node = np.concatenate(firsts), np.concatenate(sizes), np.concatenate(nodes)
            spread = mix(first, 7)
            frequent = first >= _TOP
            for chosen, common in ((~frequent, False), (frequent, True)):
                if not chosen.any():
                    continue
                if common:  # the n-gram itself names the group: no task needs all of its rows
                    part = (mix(node[chosen].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                else:
                    part = (spread[chosen] % np.uint64(parts)).astype(np.int32)
                # A part holds few enough n-grams for 32 bits; a chance equality costs one comparison.
                short = first[chosen] if common else (spread[chosen] >> np.uint64(32)).astype(np.uint32)
                found, blobs = scattered(part, {"grams": short, "sizes": size[chosen], "nodes": node[chosen]})
                yield pa.record_batch({
                    "part": pa.array(found * 2 + common, pa.int32()),
                    **{k: pa.array(v, pa.binary()) for k, v in blobs.items()},
                })
    return deal


def _groups(percent: int):
    """Members of the groups by prefix n-gram; the smallest node names a group."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"grams": np.uint8, "sizes": np.uint32, "nodes": np.int64}
        for part, held in gathered(batches, "part", kinds):
            common = part % 2 == 1
            nodes, sizes = held["nodes"], held["sizes"]
            grams = held["grams"].view(np.uint64 if common else np.uint32)
            if common:
                labels, members = grams.view(np.int64), nodes
            else:
                order = np.lexsort((sizes, grams))
                grams, nodes, sizes = grams[order], nodes[order], sizes[order].astype(np.int64)
                # A group ends where the n-gram changes or the next size is too far for any link.
                cut = np.r_[True, (grams[1:] != grams[:-1]) | (percent * sizes[1:] > 100 * sizes[:-1])]
                group = np.cumsum(cut) - 1
                firsts = np.flatnonzero(cut)
                least = np.minimum.reduceat(nodes, firsts)
                most = np.maximum.reduceat(nodes, firsts)
                shared = (least != most)[group]
                labels, members = least[group][shared], nodes[shared]
            pairs = np.unique(np.stack([labels, members], 1), axis=0) if len(labels) else np.empty((0, 2), np.int64)
            yield pa.record_batch({
                "common": pa.array(np.full(len(pairs), common)), "label": pa.array(pairs[:, 0].copy()),
                "node": pa.array(pairs[:, 1].copy()),
            })
    return meet


def _near(percent: int):
    """Classes of a group's members whose bit maps allow a link, named by their smallest document.

    Batches are sorted by group. No pair is put out; members without a possible partner go.
    """
    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sizes, maps = None, [], [], []

        def classes() -> pa.RecordBatch:
            group = possible(np.array(sizes, np.int64), maps, percent)
            docs = np.array(ids, np.int64)
            name = np.full(len(docs), np.iinfo(np.int64).max)
            np.minimum.at(name, group, docs)
            keep = np.bincount(group, minlength=len(docs))[group] > 1
            return pa.record_batch({"label": pa.array(name[group][keep]), "doc_id": pa.array(docs[keep])})

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            docs, counts, bits = batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6)
            for row, key in enumerate(keys):
                if key != now and len(ids) > 1:
                    yield classes()
                if key != now:
                    now, ids, sizes, maps = key, [], [], []
                ids.append(docs[row])
                sizes.append(counts[row])
                maps.append(np.frombuffer(bits[row].as_py(), np.uint64))
        if len(ids) > 1:
            yield classes()
    return refine


def possible(sizes: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """A class for each set such that sets of different classes can't link, by sizes and bit maps."""
    n = len(sizes)
    group = np.arange(n)
    if n == 2:  # most groups
        size = min(len(maps[0]), len(maps[1]))
        apart = int(np.bitwise_count(_folded(maps[0], size) ^ _folded(maps[1], size)).sum())
        if (100 + percent) * apart <= (100 - percent) * int(sizes.sum()) and 100 * sizes.min() >= percent * sizes.max():
            group[:] = 0
        return group
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    lengths = np.array([len(m) for m in maps])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        by_length[int(length)] = (at, np.stack([maps[k] for k in at]))
    left_out, todo = [], list(range(n - 1, -1, -1))
    while todo:
        k = todo.pop()
        counts = np.bincount(group, minlength=n)
        if counts.max() == n:
            break
        if counts[group[k]] == counts.max() > 1 and _leave_out(k, left_out, todo, group, counts):
            continue
        found = []
        for length, (at, stack) in by_length.items():
            open_ = at[group[at] != group[k]]
            fits = open_[(100 * sizes[open_] >= percent * sizes[k]) & (percent * sizes[open_] <= 100 * sizes[k])]
            if not len(fits):
                continue
            rows = stack[np.searchsorted(at, fits)]
            size = min(length, lengths[k])
            while rows.shape[1] > size:
                half = rows.shape[1] // 2
                rows = rows[:, :half] ^ rows[:, half:]
            apart = np.bitwise_count(rows ^ _folded(maps[k], size)).sum(1)
            # |difference| <= (1 - s) / (1 + s) * (sizes together) for a link
            found.append(fits[(100 + percent) * apart <= (100 - percent) * (sizes[fits] + sizes[k])])
        for g in np.unique(group[np.concatenate(found)]) if found else ():
            group[group == g] = group[k]
    return group


def _leave_out(k: int, left_out: list[int], todo: list[int], group, counts) -> bool:
    """Whether ``k``, of a largest class, need not be compared, as a link between two classes has an end elsewhere.

    That holds for one class only: when a larger one takes its place, those left out before are to be done.
    """
    if left_out and group[left_out[0]] != group[k]:
        if counts[group[left_out[0]]] == counts[group[k]]:
            return False
        todo += left_out
        left_out.clear()
    left_out.append(k)
    return True


def _members(width: int, heavy):
    """The ordered set of a document for each group and pair of blocks it belongs to."""
    schema = pa.schema([
        ("label", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("doc_id", pa.int64()), ("grams", pa.binary()),
    ])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = heavy.value
        for batch in slices(batches, "text", 2 << 20):
            values, at = ngram_sets(batch, width)
            node, _ = _digests(values, at)
            sets = _ordered(values, at, known, rank)
            rows, held = [], 0
            for doc, groups, own, s in zip(
                batch.column(0).to_pylist(), batch.column(2).to_pylist(), node.tolist(), sets, strict=True,
            ):
                raw = s.tobytes()
                for g in groups:
                    if g["node"] != own:  # another text of the same id
                        continue
                    for i, j in _blocks(own % g["blocks"], g["blocks"]):
                        rows.append((g["label"], i, j, doc, raw))
                        held += len(raw)
                        if held > 16 << 20:
                            yield _record(rows, schema)
                            rows, held = [], 0
            if rows:
                yield _record(rows, schema)
    return send


def _blocks(mine: int, blocks: int) -> list[tuple[int, int]]:
    """The pairs of blocks that a member of block ``mine`` is compared in."""
    if blocks == 1:
        return [(0, 0)]
    return [(min(mine, k), max(mine, k)) for k in range(blocks) if k != mine]


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema)


class Trie:
    """Sets in global order as paths; a path without a fork is one segment."""

    __slots__ = ("segment", "children", "ends", "least", "most")

    def __init__(self, segment: np.ndarray) -> None:
        self.segment, self.children, self.ends = segment, {}, []
        self.least, self.most = 1 << 60, 0

    def add(self, grams: np.ndarray, name: int) -> None:
        node, size, rest = self, len(grams), grams
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if not len(rest):
                node.ends.append(name)
                return
            child = node.children.get(int(rest[0]))
            if child is None:
                child = Trie(rest)
                child.least = child.most = size
                child.ends.append(name)
                node.children[int(rest[0])] = child
                return
            n = min(len(child.segment), len(rest))
            differ = np.flatnonzero(child.segment[:n] != rest[:n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.segment):
                upper = Trie(child.segment[:same])
                upper.least, upper.most = child.least, child.most
                child.segment = child.segment[same:]
                upper.children[int(child.segment[0])] = child
                node.children[int(rest[0])] = upper
                child = upper
            node, rest = child, rest[same:]

    def similar(self, grams: np.ndarray, percent: int) -> Iterator[int]:
        """The sets with 100 * intersection >= percent * union."""
        n = len(grams)
        todo = [(child, 0, 0) for child in self.children.values()]
        while todo:
            node, overlap, depth = todo.pop()
            segment = node.segment
            place = np.searchsorted(grams, segment)
            overlap += int((grams[np.minimum(place, n - 1)] == segment).sum())
            depth += len(segment)
            left = n - int(place[-1])
            if grams[min(int(place[-1]), n - 1)] == segment[-1]:
                left -= 1
            size = min(max(depth + left, node.least), node.most)
            if (100 + percent) * (overlap + min(left, size - depth)) < percent * (n + size):
                continue
            if node.ends and (100 + percent) * overlap >= percent * (n + depth):
                yield from node.ends
            todo.extend((child, overlap, depth) for child in node.children.values())


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets just as all links of the wanted similarity would.

    Sets of the largest class found so far are not probed: a link between two classes has an end
    elsewhere. When another class becomes the largest, those that were left out are probed.
    """
    tree = Trie(np.empty(0, np.uint64))
    for name, grams in enumerate(sets):
        tree.add(grams, name)
    group = list(range(len(sets)))
    held = {k: [k] for k in group}
    counts = [1] * len(sets)  # of the classes; a class that went into another one has none
    largest, links, left_out, todo = 0, [], [], list(range(len(sets) - 1, -1, -1))
    while todo:
        name = todo.pop()
        if group[name] == largest and counts[largest] > 1 and _leave_out(name, left_out, todo, group, counts):
            continue
        for other in tree.similar(sets[name], percent):
            a, b = group[name], group[other]
            if a != b:
                links.append((name, other))
                if len(held[a]) < len(held[b]):
                    a, b = b, a
                for k in held[b]:
                    group[k] = a
                held[a] += held.pop(b)
                counts[a], counts[b] = len(held[a]), 0
                if counts[a] > counts[largest]:
                    largest = a
    return links


def _joined(percent: int):
    """Links between the members of a group; batches are sorted by group."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = linked(sets, percent)
            return pa.record_batch({
                "a": pa.array([ids[a] for a, _ in found], pa.int64()),
                "b": pa.array([ids[b] for _, b in found], pa.int64()),
            })

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            docs, grams = batch.column(3).to_pylist(), batch.column(4)
            for row, key in enumerate(keys):
                if key != now and len(ids) > 1:
                    yield links()
                if key != now:
                    now, ids, sets = key, [], []
                ids.append(docs[row])
                sets.append(np.frombuffer(grams[row].as_py(), np.uint64))
        if len(ids) > 1:
            yield links()
    return join


def ngram_jaccard_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_shingles``, ``component_id``.

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their sets of ``width``
    words (A-Z lower-cased; with fewer words the whole sequence; without words nothing, and no
    link). ``component_id`` is the smallest id that links reach. The ids are integers. A row without an
    id takes part in no link and has a null component. Rows that repeat an id are one document whose
    texts all link. An empty table gives an empty result; other columns are ignored.

    Shuffled are the prefixes (a fifth of the n-grams at 80 percent), for documents that share
    a prefix n-gram a bit map, and for those whose maps allow a link their texts and sets. An n-gram of a large part of all rows comes last in the order and
    names its group itself; a group of more than ``BLOCK`` sets is cut into blocks, each pair of
    blocks being one task.
    """
    spark = df.sparkSession
    on_executors(spark)
    parts = 4 * shuffle_partitions(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = staged(docs.mapInArrow(
        _measured(width), "doc_id long, n long, d1 long, d2 long, bits binary, gram long, times long"))
    measured = both.where("n is not null").select("doc_id", "n", "d1", "d2")
    total = measured.agg(F.sum("n")).first()[0] or 0
    frequent = (
        both.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times"))
        .where(F.col("times") >= max(3, -(-total // HEAVY))).orderBy("times", "gram").limit(HEAVY).toPandas()
    )
    grams = frequent["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    heavy = spark.sparkContext.broadcast((grams[order], order))

    classes = staged(both.where("d1 is not null").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    prefixes = docs.mapInArrow(
        _prefixes(width, percent, parts, heavy), "part int, grams binary, sizes binary, nodes binary")
    groups = (
        prefixes.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part")
        .mapInArrow(_groups(percent), "common boolean, label long, node long").distinct()
    )
    groups = staged(groups)
    counts = groups.groupBy("common", "label").agg(F.ceil(F.count("*") / MAPS).cast("int").alias("blocks"))
    block = F.pmod("node", "blocks").cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(block)).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), block)))
    mapped = (
        groups.join(counts, ["common", "label"])
        .join(classes.select(F.col("d1").alias("node"), F.col("first_id").alias("doc_id"), "n", "bits"), "node")
        .select("common", "label", block.alias("own"), other.alias("other"), "doc_id", "n", "bits")
        .select("common", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                "doc_id", "n", "bits")
    )
    keys = ["common", "label", "i", "j"]
    near = staged(mapped.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(
        _near(percent), "label long, doc_id long").distinct())

    counts = near.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = (
        near.join(counts, "label")
        .join(classes.select("d1", "first_id"), F.col("doc_id") == F.col("first_id"))
        .groupBy("doc_id").agg(F.collect_list(F.struct("label", F.col("d1").alias("node"), "blocks")).alias("groups"))
    )
    members = docs.join(wanted, "doc_id").mapInArrow(
        _members(width, heavy), "label long, i int, j int, doc_id long, grams binary")
    keys = ["label", "i", "j"]
    links = members.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(
        _joined(percent), "a long, b long")
    reached = connected_components(links.union(_repeated_ids(measured, classes)))
    first = classes.join(reached, classes.first_id == reached.node, "left").select(
        "d1", "d2", F.coalesce("component", "first_id").alias("component"))
    return measured.join(first, ["d1", "d2"], "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"))


def _repeated_ids(measured: DataFrame, classes: DataFrame) -> DataFrame:
    """Links an id that has several texts with the class of each."""
    digest = F.struct("d1", "d2")
    several = measured.where("d1 is not null").groupBy("doc_id").agg(
        F.min(digest).alias("least"), F.max(digest).alias("most")).where("least <> most")
    return measured.join(several, "doc_id", "semi").join(classes, ["d1", "d2"]).select(
        F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
