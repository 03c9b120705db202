"""Lossless subword ids with seeded merge-dropout.

Candidate merges form an agenda in the order of the vocabulary; each is skipped where a keyed hash says so,
so texts get varied segmentations that are the same in every run. A part of a text, white space and
what follows it up to the next, is segmented by itself: no piece goes on from a letter into white space.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.staging import long_array, on_executors, slices
from lodeseek.llm.tokenizing import sent
from lodeseek.llm.words import mix

SPACE = chr(0x2581)  # stands for a space in pieces
_PART = re.compile(" *[^ ]+| +")
_HELD = 1_000_000  # nodes of the segmentation trees that a worker keeps
_OFTEN = 3  # occurrences of a batch that make a branch worth growing
_LONG = 48  # characters; longer parts are segmented one by one and not kept
_ALL = (1 << 64) - 1
_NONE = 1 << 40  # no merge
_LETTERS = 512  # different letters whose pairs are a table
_codecs: dict[tuple, Codec] = {}


class Codec:
    """``dropout`` is the share of candidate merges that are skipped; every occurrence of a part has a draw of its own.

    The segmentations of a part form a tree: a node is the next candidate that can be taken, its branches
    are taking and skipping it, a leaf has the ids. Trees grow where ``_OFTEN`` occurrences ask for a branch, up to ``held`` nodes.
    """

    def __init__(self, path: str, dropout: float, seed: int, held: int = _HELD) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.pieces))
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        # Candidates are taken by score, so the place in that order names a merge.
        by_score = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = {self.pieces[i]: r for r, i in enumerate(by_score)}
        bytes_ = {int(self.pieces[i][1:-1], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.byte_id = [bytes_[b] for b in range(256)]
        self.raw = [piece.replace(SPACE, " ").encode() for piece in self.pieces]
        for b, i in bytes_.items():
            self.raw[i] = bytes([b])
        self.bound = int(dropout * (1 << 32))
        self.seed, self.held = seed * 0x9E3779B97F4A7C15 & _ALL, held
        self._forget()
        table = {}
        for piece, order in self.rank.items():
            for cut in range(1, len(piece)):
                a, b = self.id_of.get(piece[:cut]), self.id_of.get(piece[cut:])
                if a is not None and b is not None:
                    table[a << 32 | b] = (order, self.id_of[piece])
        self.pairs = np.array(sorted(table), np.int64)
        self.merges = np.array([table[k] for k in sorted(table)], np.int64).reshape(-1, 2)
        self.by_order = np.array(by_score, np.int64)  # the id that a merge makes

    def _forget(self) -> None:
        self.roots: dict[str, int] = {}
        self.leaves: list[bytes | None] = []
        self.nodes = array("q")  # three of each: the candidate or -1 at a leaf, the next node if taken, if skipped

    def _grow(self, part: str, draw: int) -> None:
        """Adds what the tree of ``part`` lacks for this draw."""
        trail: list[tuple[int, bool]] = []
        ids = self.segment(part, draw, trail)
        nodes, leaves = self.nodes, self.leaves
        at, deep, last = self.roots.get(part, -1), 0, len(trail)
        if at < 0:
            self.roots[part] = len(leaves)
        else:
            while deep < last:
                branch = 3 * at + 1 + trail[deep][1]
                at, deep = nodes[branch], deep + 1
                if at < 0:
                    nodes[branch] = len(leaves)
                    break
            else:
                return
        # The rest of the trail is a chain.
        k = len(leaves)
        for candidate, skipped in trail[deep:]:
            k += 1
            nodes.extend((candidate, -1, k) if skipped else (candidate, k, -1))
        nodes.extend((-1, -1, -1))
        leaves.extend([None] * (last - deep))
        leaves.append(ids)

    def segment(self, part: str, draw: int, trail: list[tuple[int, bool]] | None = None) -> bytes:
        """The ids of one part; ``segments`` does the same for many. ``trail`` gets the candidates and which were skipped."""
        order_of, bound, key = self.rank.get, self.bound, (self.seed + draw * 0xD1B54A32D192ED03) & _ALL
        # A literal SPACE must not be taken for a space; with a mark before it no piece has it.
        held: list[str | None] = (
            list(part.replace(" ", SPACE)) if SPACE not in part else [SPACE if c == " " else "\0" + c if c == SPACE else c for c in part])
        n = len(held)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            piece = held[i] + held[i + 1]
            if (order := order_of(piece)) is not None:
                agenda.append((order, i, piece))
        heapify(agenda)
        while agenda:
            order, i, piece = heappop(agenda)
            j = right[i]
            if held[i] is None or j >= n or held[i] + held[j] != piece:
                continue
            h = (key ^ (order << 20 | i)) * 0xBF58476D1CE4E5B9 & _ALL
            skipped = ((h ^ h >> 31) * 0x94D049BB133111EB & _ALL) >> 32 < bound
            if trail is not None:
                trail.append((order << 20 | i, skipped))
            if skipped:
                continue
            held[i], held[j] = piece, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                wider = piece + held[k]
                if (order := order_of(wider)) is not None:
                    heappush(agenda, (order, i, wider))
            if (k := left[i]) >= 0:
                wider = held[k] + piece
                if (order := order_of(wider)) is not None:
                    heappush(agenda, (order, k, wider))
        out, id_of = array("I"), self.id_of
        for piece in held:
            if piece is not None:
                known = id_of.get(piece)
                out.extend([known] if known is not None else self._bytes(piece.removeprefix("\0") or piece))
        return out.tobytes()

    def _bytes(self, character: str) -> list[int]:
        return [self.byte_id[b] for b in character.encode("utf-8", "surrogatepass")]

    def _orders(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The order of merging symbols ``a`` and ``b``, or that there is no such merge."""
        pair = a << 32 | b
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[place] == pair, self.merges[place, 0], _NONE)

    def _offers(self, order: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """``order`` of merges whose first symbols are at ``at``, without those that are skipped."""
        order[self._skipped(keys, order << 20 | at)] = _NONE
        return order

    def _keys(self, draws: np.ndarray) -> np.ndarray:
        return np.uint64(self.seed) + draws * np.uint64(0xD1B54A32D192ED03)

    def _skipped(self, keys: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        h = (keys ^ candidates.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return h >> np.uint64(32) < self.bound

    def segments(self, parts: list[str], draws: list[int] | np.ndarray) -> list[bytes]:
        """The ids of each part: a row for each, one merge of the first candidate in every step, by width."""
        n = len(parts)
        out: list[bytes] = [b""] * n
        sizes = np.array([len(p) for p in parts])
        flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, which = np.unique(flat, return_inverse=True)
        unknown = len(self.pieces)
        names = [SPACE if c == 32 else "" if chr(c) == SPACE else chr(c) for c in letters.tolist()]
        ids = np.array([self.id_of.get(c, unknown + k) for k, c in enumerate(names)], np.int64)
        which = which.reshape(-1) if len(which) else np.empty(0, np.int64)
        # Few letters: all their pairs are looked up once.
        table = self._orders(ids[:, None], ids) if len(ids) <= _LETTERS else None
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        keys = self._keys(np.array(draws, np.uint64))
        empty = np.empty((0, 0), np.int64)
        who, now, at, best = np.empty(0, np.int64), empty, empty, empty
        for width in range(int(sizes.max(initial=0)), 0, -1):
            fresh = np.flatnonzero(sizes == width)
            if not len(fresh) and not len(who):
                continue
            if len(fresh):
                place = which[starts[fresh][:, None] + np.arange(width)]
                own, places = ids[place], np.broadcast_to(np.arange(width), place.shape)
                orders = self._orders(own[:, :-1], own[:, 1:]) if table is None else table[place[:, :-1], place[:, 1:]]
                offers = self._offers(orders, places[:, :-1], keys[fresh][:, None])
                if len(who):
                    who, now = np.r_[who, fresh], np.concatenate([now, own])
                    at, best = np.concatenate([at, places]), np.concatenate([best, offers])
                else:
                    who, now, at, best = fresh, own, places, offers
            if width > 1:
                first = best.argmin(1)
                order = best[np.arange(len(who)), first]
                go = order < _NONE
            else:
                go = np.zeros(len(who), bool)
            self._finish(out, who[~go], now[~go], letters)
            if width == 1 or not go.any():
                who, now, at, best = who[:0], now[:0, :-1], at[:0, :-1], best[:0, :-1]
                continue
            who, first, order = who[go], first[go], order[go]
            line = np.arange(len(who))
            keep = np.arange(width - 1) + (np.arange(width - 1) > first[:, None])
            now, at, best = now[go], at[go], best[go]
            now[line, first] = self.by_order[order]
            now, at = np.take_along_axis(now, keep, 1), np.take_along_axis(at, keep, 1)
            # Offers stand between symbols: the one taken goes, its neighbours are made anew.
            gone = np.arange(width - 2) + (np.arange(width - 2) >= first[:, None])
            best = np.take_along_axis(best, gone, 1)
            rows = np.flatnonzero(first < width - 2)
            f = first[rows]
            best[rows, f] = self._offers(self._orders(now[rows, f], now[rows, f + 1]), at[rows, f], keys[who[rows]])
            rows = np.flatnonzero(first > 0)
            f = first[rows]
            best[rows, f - 1] = self._offers(self._orders(now[rows, f - 1], now[rows, f]), at[rows, f - 1], keys[who[rows]])
        return out

    def _finish(self, out: list[bytes], who: np.ndarray, rows: np.ndarray, letters: np.ndarray) -> None:
        if not len(who):
            return
        odd = (rows >= len(self.pieces)).any(1)
        raw, step = rows.astype(np.uint32).tobytes(), 4 * rows.shape[1]
        for k, name in enumerate(who.tolist()):
            out[name] = raw[k * step:(k + 1) * step]
        for k in np.flatnonzero(odd).tolist():
            ids = array("I")
            for i in rows[k].tolist():
                ids.extend([i] if i < len(self.pieces) else self._bytes(chr(letters[i - len(self.pieces)])))
            out[int(who[k])] = ids.tobytes()

    def encode(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; its key (of the document) and a part's place give the part's draw."""
        cut = [_PART.findall(" " + text) if text else [] for text in texts]
        draws = np.concatenate([np.empty(0, np.uint64)] + [
            mix(np.arange(len(parts), dtype=np.uint64) + np.uint64(key & _ALL), 41)
            for parts, key in zip(cut, keys, strict=True)])
        if len(self.leaves) > self.held:
            self._forget()
        every = [part for parts in cut for part in parts]
        found = self._walked(every, draws)
        out, lo = [], 0
        for parts in cut:
            out.append(b"".join(found[lo:lo + len(parts)]))
            lo += len(parts)
        return out

    def _seen(self) -> np.ndarray:
        return np.frombuffer(self.nodes, np.int64).reshape(-1, 3)

    def _walked(self, parts: list[str], draws: np.ndarray) -> list[bytes]:
        """The ids of each part: by its tree, which grows where ``_OFTEN`` or more ask for a branch, or else by itself."""
        roots, often = self.roots, Counter(parts)
        for part, n in often.items():
            if n >= _OFTEN and part not in roots and len(part) <= _LONG:
                self._grow(part, 0)
        at = np.fromiter(map(roots.get, parts, repeat(-1)), np.int64, len(parts))
        keys = self._keys(draws)
        todo = np.flatnonzero(at >= 0)
        while len(todo):
            nodes = self._seen()
            candidates = nodes[at[todo], 0]
            inner = candidates >= 0
            todo, candidates = todo[inner], candidates[inner]
            now = at[todo]
            side = 1 + self._skipped(keys[todo], candidates)
            after = nodes[now, side]
            lacking = np.flatnonzero(after < 0)
            del nodes  # it can't grow while it is seen
            if len(lacking):
                _, firsts, times = np.unique(2 * now[lacking] + side[lacking], return_index=True, return_counts=True)
                for k in todo[lacking[firsts[times >= _OFTEN]]].tolist():
                    self._grow(parts[k], int(draws[k]))
                after[lacking] = self._seen()[now[lacking], side[lacking]]
            at[todo] = after
            todo = todo[after >= 0]
        leaves = self.leaves
        out = [leaves[a] if a >= 0 else b"" for a in at.tolist()]
        alone = np.flatnonzero(at < 0).tolist()
        short = [k for k in alone if len(parts[k]) <= _LONG]
        for lo in range(0, len(short), 20_000):
            some = short[lo:lo + 20_000]
            for k, ids in zip(some, self.segments([parts[k] for k in some], draws[some]), strict=True):
                out[k] = ids
        for k in alone:
            if len(parts[k]) > _LONG:
                out[k] = self.segment(parts[k], int(draws[k]))
        return out

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, np.uint32).tolist()]).decode("utf-8", "surrogatepass")
        return text[1:]


def codec(name: str, dropout: float, seed: int) -> Codec:
    """The codec of a file sent by ``sent``, one for each Python worker."""
    key = (name, dropout, seed)
    if key not in _codecs:
        _codecs[key] = Codec(SparkFiles.get(name), dropout, seed)
    return _codecs[key]


def _encoded(name: str, dropout: float, seed: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(name, dropout, seed)
        for batch in slices(batches, "text", 2 << 20):
            docs, _ = long_array(batch.column(0))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = model.encode(texts, mix(docs.view(np.uint64), seed & 0xFFFF).tolist())
            yield pa.record_batch({
                "doc_id": batch.column(0), "ids": pa.array(ids, pa.binary()),
                "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
            })
    return encode


def encode(
    df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1,
    seed: int = 1,
) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_crc32`` of each row: little-endian 32-bit ids with a share of merges dropped.

    The skips depend on ``seed``, the id, the place of a part in its text, the merge and its place in the
    part, so every occurrence of a word has skips of its own. Without
    dropout the ids are the model's own. A null or empty text has no ids; a null id counts as 0; repeated rows get
    equal ids. Characters without a piece, and the sign that stands for spaces in pieces, are spelled in
    byte pieces, so ``decode`` gives back every text. An empty table gives an empty result.
    """
    spark = df.sparkSession
    on_executors(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(
        _encoded(sent(spark, model_path), dropout, seed),
        "doc_id long, ids binary, n_tokens long, ids_crc32 long")


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text that ``ids_col`` stands for in ``text_col``; null for null."""
    name = sent(df.sparkSession, model_path)
    on_executors(df.sparkSession)

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        model = codec(name, 0.0, 0)
        return pa.array([None if i.as_py() is None else model.decode(i.as_py()) for i in ids], pa.string())

    return df.withColumn(text_col, text_of(F.col(ids_col)))
