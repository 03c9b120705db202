"""Phrase collocations from counting quotient filters.

A word's id is a 64-bit hash of its language and its letters; that no two words share one is checked over
the whole vocabulary, and another seed is taken if two do. An n-gram is its packed ids. An invertible map
replaces the first id by a number ``g`` mixed from all of them: the top bits of ``g`` choose a part and, in
it, a slot (the quotient); the rest of ``g`` and the other ids are the remainder, which is kept in full. So a
filter is a count of entries for each slot, remainders in slot order, and counters of a byte that spill
over: compact, and lossless, for the map can be undone. Each slice of the texts gives one sorted filter for
each part; a part merges its filters by adding up counters.

Only phrases whose parts are frequent can be frequent, so lengths are counted one after the other, and an
n-gram enters a filter only if bitmaps of a bounded size let its words and its shorter phrases pass. A
bitmap may let too much pass, never too little; the counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.staging import on_executors, shuffle_partitions, slices, staged
from lodeseek.llm.words import _WEIGHTS, Words, mix

PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
NO_WORD = PIECE_ENDS.copy()
NO_WORD[[ord(" "), ord("\t")]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LONGEST = 4
SLICE = 5 << 20  # bytes of text that one filter is made of
RUN = 1 << 19  # words that are looked at together
PENDING = 2 << 20  # entries that wait for a merge
PART_BYTES = 48 << 20
LEAST_BITS, MOST_BITS = 20, 28  # of a bitmap: 128 KB to 32 MB

_ONE = np.uint64(1)


def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def unmix(h: np.ndarray, seed: int) -> np.ndarray:
    """What ``mix`` made ``h`` from."""
    def back(x: np.ndarray, shift: int) -> np.ndarray:
        out = x
        for _ in range(64 // shift + 1):
            out = x ^ (out >> np.uint64(shift))
        return out

    h = back(h, 31) * _inverse(0x94D049BB133111EB)
    h = back(h, 27) * _inverse(0xBF58476D1CE4E5B9)
    return back(h, 30) - np.uint64(seed)


def permuted(ids: list[np.ndarray]) -> np.ndarray:
    """The number that takes the place of the first id: a bijection of it for any other ids."""
    total = np.zeros(len(ids[0]), np.uint64)
    for k, column in enumerate(ids):
        total += column * _WEIGHTS[k]
    return mix(total, len(ids))


def restored(g: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The first id of an n-gram."""
    total = unmix(g, len(others) + 1)
    for k, column in enumerate(others, 1):
        total = total - column * _WEIGHTS[k]
    return total * _inverse(_WEIGHTS[0])


def summed(g: np.ndarray, others: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct entries in the order of ``g`` with their counts added up."""
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    if any((column[order][1:] != column[order][:-1])[same].any() for column in others):
        order = np.lexsort((*others[::-1], g))  # ids that agree in g only
    g, others, counts = g[order], [column[order] for column in others], counts[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    for column in others:
        new[1:] |= column[1:] != column[:-1]
    firsts = np.flatnonzero(new)
    total = np.add.reduceat(counts, firsts) if len(firsts) else counts
    return g[firsts], [column[firsts] for column in others], total


class Filter:
    """A counting quotient filter of one part in the form it is sent in."""

    @staticmethod
    def packed(g: np.ndarray, others: list[np.ndarray], counts: np.ndarray, part_bits: int) -> dict[str, object]:
        """Entries in the order of ``g``, all with the same ``part_bits`` leading bits."""
        bits = max(0, min(20, len(g).bit_length() - 3))
        local = (g << np.uint64(part_bits)) if part_bits else g
        slot = (local >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(g), np.int64)
        width = -(-(64 - part_bits - bits) // 8)
        rest = local << np.uint64(bits) if bits else local
        big = rest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]
        over = counts >= 255
        return {
            "bits": bits, "slots": np.bincount(slot, minlength=1 << bits).astype(np.uint32).tobytes(),
            "rest": big.tobytes(), "others": b"".join(column.tobytes() for column in others),
            "counts": np.where(over, 255, counts).astype(np.uint8).tobytes(), "over": counts[over].astype(np.int64).tobytes(),
        }

    @staticmethod
    def unpacked(part: int, part_bits: int, size: int, row: dict[str, object]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        bits = row["bits"]
        runs = np.frombuffer(row["slots"], np.uint32)
        slot = np.repeat(np.arange(len(runs), dtype=np.uint64), runs)
        n, width = len(slot), -(-(64 - part_bits - bits) // 8)
        big = np.zeros((n, 8), np.uint8)
        big[:, :width] = np.frombuffer(row["rest"], np.uint8).reshape(n, width)
        local = big.view(">u8").reshape(-1).astype(np.uint64)
        local = (local >> np.uint64(bits)) | (slot << np.uint64(64 - bits)) if bits else local
        g = (local >> np.uint64(part_bits)) | np.uint64(part << (64 - part_bits)) if part_bits else local
        ids = np.frombuffer(row["others"], np.uint64).reshape(size - 1, n)
        counts = np.frombuffer(row["counts"], np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(row["over"], np.int64)
        return g, list(ids), counts


FILTERS = "part int, bits int, slots binary, rest binary, others binary, counts binary, over binary"


class Bitmap:
    """Which numbers may be there, by their leading bits."""

    def __init__(self, bits: int, data: bytes) -> None:
        self.bits, self.data = bits, np.frombuffer(data, np.uint8)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        place = (numbers >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def bitmap(numbers: DataFrame, column: str, count: int) -> Bitmap:
    """The bitmap of a long column; its size follows ``count`` up to ``2 ** MOST_BITS`` bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, (count * 32).bit_length()))
    place = F.shiftrightunsigned(column, 64 - bits)
    rows = numbers.select(F.floor(place / 32768).cast("int").alias("block"), (place % 32768).alias("bit")).groupBy("block").agg(
        F.bitmap_construct_agg("bit").alias("bits")).collect()
    data = bytearray(1 << (bits - 3))
    for row in rows:
        data[row.block * 4096:row.block * 4096 + len(row.bits)] = row.bits
    return Bitmap(bits, bytes(data))


def _word_ids(batch: pa.RecordBatch, seed: int) -> tuple[Words, np.ndarray, np.ndarray, list[str]]:
    """Words of a slice, their ids, the text each is of, and the languages of the texts."""
    words = Words(batch.column("text"), NO_WORD)
    langs = batch.column("lang").to_pylist()
    text = np.repeat(np.arange(len(langs)), np.diff(words.at))
    salts = {lang: _language(lang, seed) for lang in set(langs)}
    salt = np.array([salts[lang] for lang in langs], np.uint64)
    ids = mix(words.hashes(folded=True) + (words.ends - words.starts).astype(np.uint64) * _WEIGHTS[8] + salt[text], seed)
    return words, ids, text, langs


def _language(lang: str, seed: int) -> int:
    raw = lang.encode()
    at = np.frombuffer(raw, np.uint8).astype(np.uint64) + _ONE
    powers = np.cumprod(np.full(len(raw), _WEIGHTS[9], np.uint64), dtype=np.uint64)
    return int(mix(np.array([(at * powers).sum(dtype=np.uint64)], np.uint64), len(raw) + seed)[0])


def _vocabulary(seed: int):
    """The distinct words of each slice with how often they occur."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words, ids, text, langs = _word_ids(batch, seed)
            found, first, counts = np.unique(ids, return_index=True, return_counts=True)
            starts, sizes = words.starts[first], (words.ends - words.starts)[first]
            ends = np.cumsum(sizes)
            place = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
            letters = FOLD[words.data[place]]
            strings = pa.LargeStringArray.from_buffers(
                len(found), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(letters.tobytes()))
            lang = pa.array(langs, pa.string()).take(pa.array(text[first]))
            yield pa.record_batch({
                "id": pa.array(found.view(np.int64)), "lang": lang, "word": strings.cast(pa.string()), "f": pa.array(counts)})
    return count


def _filters(size: int, seed: int, part_bits: int, words_bitmap: Bitmap, shorter: Bitmap | None):
    """A filter of the n-grams of each slice for each part."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words, ids, text, _ = _word_ids(batch, seed)
            if len(ids) < size:
                continue
            # A word goes on the piece of the one before it if no piece ends between them.
            ends = np.flatnonzero(PIECE_ENDS[words.data])
            piece = np.searchsorted(ends, words.starts)
            joined = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
            often = words_bitmap.has(ids)
            joined &= often[1:] & often[:-1]
            held: list[tuple[np.ndarray, ...]] = []
            for lo in range(0, len(ids) - size + 1, RUN):
                hi = min(lo + RUN, len(ids) - size + 1)
                good = np.ones(hi - lo, bool)
                for k in range(size - 1):
                    good &= joined[lo + k:hi + k]
                at = np.flatnonzero(good) + lo
                if shorter is not None:
                    parts = [[ids[at + k + s] for k in range(size - 1)] for s in (0, 1)]
                    passed = shorter.has(permuted(parts[0]))
                    passed[passed] = shorter.has(permuted([column[passed] for column in parts[1]]))
                    at = at[passed]
                grams = [ids[at + k] for k in range(size)]
                g, others, counts = summed(permuted(grams), grams[1:], np.ones(len(at), np.int64))
                held.append((g, others, counts))
            g = np.concatenate([h[0] for h in held])
            others = [np.concatenate([h[1][k] for h in held]) for k in range(size - 1)]
            counts = np.concatenate([h[2] for h in held])
            if len(held) > 1:
                g, others, counts = summed(g, others, counts)
            part = (g >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(g), np.int64)
            numbers, firsts = np.unique(part, return_index=True)
            bounds = np.r_[firsts, len(g)]
            rows = [{"part": int(number), **Filter.packed(g[a:b], [column[a:b] for column in others], counts[a:b], part_bits)}
                    for number, a, b in zip(numbers, bounds[:-1], bounds[1:], strict=True)]
            yield from _rows(rows)
    return count


def _rows(rows: list[dict[str, object]]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("bits", pa.int32()), *[(c, pa.binary()) for c in ("slots", "rest", "others", "counts", "over")]])
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _merged(size: int, part_bits: int, least: int):
    """The n-grams of each part that occur ``least`` times, from filters sorted by part."""
    def result(now: int, g: np.ndarray, others: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        often = counts >= least
        g, others, counts = g[often], [column[often] for column in others], counts[often]
        ids = np.stack([restored(g, others), *others], 1)
        words = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1, dtype=np.int32) * size), pa.array(ids.reshape(-1).view(np.int64)))
        return pa.record_batch({"g": pa.array(g.view(np.int64)), "ids": words, "f": pa.array(counts)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = None, [], 0

        def whole():
            return summed(np.concatenate([h[0] for h in held]),
                          [np.concatenate([h[1][k] for h in held]) for k in range(size - 1)], np.concatenate([h[2] for h in held]))

        for batch in batches:
            columns = {c: batch.column(c) for c in ("bits", "slots", "rest", "others", "counts", "over")}
            for k, part in enumerate(batch.column("part").to_pylist()):
                if now is not None and part != now:
                    yield result(now, *whole())
                    held, waiting = [], 0
                now = part
                held.append(Filter.unpacked(part, part_bits, size, {c: column[k].as_py() for c, column in columns.items()}))
                waiting += len(held[-1][0])
                if waiting > PENDING and len(held) > 1:
                    held, waiting = [whole()], 0
        if now is not None:
            yield result(now, *whole())
    return merge


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, cover: int = 80,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of two to four words that stand out most in each language.

    Texts are lower-cased (A-Z), cut to pieces at ``[.,;:!?]`` and line ends, and those to words at spaces
    and tabs; a null text is empty, a null language is ``und``. ``a`` counts a phrase's occurrences within
    pieces, ``least`` or more; ``l`` and ``r`` those of the two sides of the cut with the lowest score, which is
    ``floor(2000000 * a / (l + r))`` (the first such cut); ``n`` counts all words of the language. A phrase
    that lies in a longer candidate with ``cover`` percent of its occurrences or more is left out. The first
    ``top`` of a language by score, then ``a``, then phrase in the order of its bytes. Repeated rows count
    each; other columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    on_executors(spark)
    n = shuffle_partitions(spark)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))

    seed = 1
    while True:
        words = staged(texts.mapInArrow(_vocabulary(seed), "id long, lang string, word string, f long").groupBy(
            "id", "lang", "word").agg(F.sum("f").alias("f")))
        # One id for two words would add up what is not the same.
        if words.groupBy("id").agg(F.count("*").alias("words"), F.sum("f").alias("f")).where(
                (F.col("words") > 1) & (F.col("f") >= least)).isEmpty():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    common = staged(words.where(F.col("f") >= least))
    every = words.agg(F.sum("f")).first()[0] or 0
    words_bitmap = bitmap(common, "id", common.count())

    levels, shorter = [], None
    for size in range(2, LONGEST + 1):
        # Parts by what all n-grams would take, at most 64 bytes each with their sorting.
        part_bits = max(n - 1, every * 24 // PART_BYTES).bit_length()
        sent = texts.mapInArrow(_filters(size, seed, part_bits, words_bitmap, shorter), FILTERS)
        grams = staged(sent.repartition(max(n, min(1 << part_bits, 8 * n)), "part").sortWithinPartitions("part").mapInArrow(
            _merged(size, part_bits, least), "g long, ids array<long>, f long"))
        levels.append(grams.select("ids", "f"))
        if size < LONGEST:
            shorter = bitmap(grams, "g", grams.count())

    phrases = levels[0]
    for grams in levels[1:]:
        phrases = phrases.union(grams)
    counts = phrases.union(common.select(F.array("id").alias("ids"), "f"))
    wide = "decimal(20,0)"
    cut = phrases.select("ids", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    sides = cut.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    scored = sides.join(counts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(
        counts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right").withColumn(
        "score", F.expr(f"(cast(a as {wide}) * 2000000) div (cast(l as {wide}) + cast(r as {wide}))"))
    lowest = scored.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("ids", "a", "s.score", "s.l", "s.r")

    inner = F.explode(F.expr(
        "flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), p -> slice(ids, p, m))))"))
    covering = phrases.where(F.size("ids") > 2).select(inner.alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    covered = F.expr(f"100 * cast(longer as {wide}) >= {cover} * cast(a as {wide})")
    apart = lowest.join(covering, "ids", "left").where(~F.coalesce(covered, F.lit(False))).drop("longer")

    first = common.select(F.col("id").alias("first"), "lang")
    told = staged(apart.withColumn("first", F.element_at("ids", 1)).join(first, "first").drop("first"))
    # Ranks in shares of a language first, so no task sorts a whole one; ties at the border all stay.
    share = F.pmod(F.xxhash64("ids"), F.lit(64))
    best = [F.desc("score"), F.desc("a")]
    near = told.withColumn("share", share).withColumn("rank", F.rank().over(Window.partitionBy("lang", "share").orderBy(*best)))
    near = near.where(F.col("rank") <= top).drop("rank", "share")
    near = near.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top).drop("rank")
    spelled = near.select("ids", F.posexplode("ids").alias("at", "id")).join(common.select("id", "word"), "id").groupBy("ids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("phrase"))
    named = near.join(spelled, "ids").join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(*best, "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
