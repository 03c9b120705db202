"""Repair of conversation structure at the least cost, on grammar-compressed role and fault sequences.

Each row of a conversation becomes a symbol: its role and whether it must go (blank or a duplicate), is cut
off, or is sound. Pairs of symbols that follow each other most often, counted over all conversations, become
symbols themselves (Re-Pair), for some rounds. Every symbol has one transfer matrix over the states of the
grammar ``(s?(ua)+)?``: the least cost from state to state, which of two equal costs has the smaller audit,
and the state in the middle, so the audit is a rope over the rules and is only spelled out for the path
that is taken. Matrices are built bottom-up and shared by all conversations; equal sequences are evaluated
once. How far pairs are joined changes the speed and never the result.

No edit comes after a part's last row, so of two audits of a part none begins the other, and the smaller
audits of the parts make the smaller audit of the whole.

Long conversations are cut into pieces of bounded length in one global order of rows; the matrices of the
pieces are joined in a tree, and the states found at its root go back down to the pieces. Decisions are made
on narrow rows that hold a digest in place of the text; texts meet the kept rows in one join at the end.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.staging import on_executors, shuffle_partitions, staged

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
CUT_OFF = 1  # what an undeleted truncated row adds
# State 0 is the start, 1 follows the system row, 2 a user row, 3 an assistant row; 0 and 3 may end.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = ("user", "user", "assistant", "user")  # what a state takes from an insertion or a new role
NONE = 1 << 40
# Sound rows by role initial, truncated ones, and those that must go.
SOUND, TRUNCATED, GONE = "suao", "SUAO", "1234"
SYMBOLS = SOUND + TRUNCATED + GONE
FIRST_RULE = 0xE000  # private code points
PIECE, COPIES, FAN = 8192, 256, 256  # rows of a piece, copies in a row, parts of a node
SPELL = 4096  # rows whose audit is kept once it is spelled out


def _closing() -> tuple[np.ndarray, dict[tuple[int, int], str]]:
    """Least cost and letters of insertions from state to state."""
    cost, letters = np.full((4, 4), NONE, np.int64), {}
    for p in range(4):
        q, spent, text = p, 0, ""
        while cost[p, q] > spent:
            cost[p, q], letters[p, q] = spent, text
            q, spent, text = STEP[q, "a" if q == 2 else "u"], spent + INSERT, text + "I"
    return cost, letters


GAPS, GAP_LETTERS = _closing()
END = np.minimum(GAPS[:, 0], GAPS[:, 3])
END_LETTERS = [GAP_LETTERS[q, 0] if q == 0 else GAP_LETTERS[q, 3] for q in range(4)]


def row_letters(symbol: str) -> dict[tuple[int, int], str]:
    """The cheapest edits of one row, with the insertions before it, for each pair of states that has any."""
    role = "suao"[SYMBOLS.index(symbol) % 4]
    extra = CUT_OFF if symbol in TRUNCATED else 0
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for p in range(4):
        for r in range(4):
            if GAPS[p, r] >= NONE:
                continue
            moves = [(r, DELETE, "D")]
            if symbol not in GONE:
                if (r, role) in STEP:
                    moves.append((STEP[r, role], KEEP + extra, "K"))
                moves.append((STEP[r, WANTED[r][0]], REROLE + extra, "R"))
            for q, cost, letter in moves:
                way = (int(GAPS[p, r]) + cost, GAP_LETTERS[p, r] + letter)
                found[p, q] = min(found.get((p, q), way), way)
    return {k: v for k, v in found.items()}


def joined(left_cost, left_rank, right_cost, right_rank):
    """Cost, rank of the audit among those of a row of the matrix, and middle state; arrays of (n, 4, 4)."""
    both = np.minimum(left_cost[:, :, :, None] + right_cost[:, None, :, :], NONE)
    middle = (both * 4 + left_rank[:, :, :, None]).argmin(2)
    cost = np.take_along_axis(both, middle[:, :, None, :], 2)[:, :, 0, :]
    at = np.arange(len(middle))[:, None, None]
    start, end = np.arange(4)[None, :, None], np.arange(4)[None, None, :]
    order = left_rank[at, start, middle] * 4 + right_rank[at, middle, end]
    return cost, order.argsort(2, kind="stable").argsort(2, kind="stable"), middle.astype(np.int8)


class Grammar:
    """Rules, and one matrix for each symbol: a row's own or a rule's."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = rules
        self.number = {c: k for k, c in enumerate(SYMBOLS)}
        cost, rank = np.full((len(SYMBOLS), 4, 4), NONE, np.int64), np.zeros((len(SYMBOLS), 4, 4), np.int64)
        self.letters: dict[tuple[int, int, int], str] = {}
        for k, symbol in enumerate(SYMBOLS):
            ways = row_letters(symbol)
            for p in range(4):
                audits = sorted(ways[p, q][1] for q in range(4) if (p, q) in ways)
                for q in range(4):
                    if (p, q) in ways:
                        cost[k, p, q], self.letters[k, p, q] = ways[p, q][0], ways[p, q][1]
                        rank[k, p, q] = audits.index(ways[p, q][1])
                    else:
                        rank[k, p, q] = 3
        costs, ranks, self.middles, self.sizes = list(cost), list(rank), {}, [1] * len(SYMBOLS)
        for name, (left, right) in zip(self.names(), rules, strict=True):
            a, b = self.number[left], self.number[right]
            c, r, m = joined(costs[a][None], ranks[a][None], costs[b][None], ranks[b][None])
            self.number[name] = len(costs)
            self.middles[len(costs)] = (a, b, m[0])
            costs.append(c[0])
            ranks.append(r[0])
            self.sizes.append(self.sizes[a] + self.sizes[b])
        self.cost, self.rank = np.array(costs), np.array(ranks)

    def names(self) -> list[str]:
        return [chr(FIRST_RULE + k) for k in range(len(self.rules))]

    def compressed(self, sequence: str) -> str:
        for name, pair in zip(self.names(), self.rules, strict=True):
            sequence = sequence.replace("".join(pair), name)
        return sequence

    def spelled(self, symbol: int, p: int, q: int) -> str:
        """The audit of a symbol from one state to another; a rope's leaves from left to right."""
        out, todo = [], [(symbol, p, q)]
        while todo:
            k, a, b = now = todo.pop()
            if now in self.letters:
                out.append(self.letters[now])
                continue
            left, right, middle = self.middles[k]
            m = int(middle[a, b])
            if self.sizes[k] <= SPELL:
                self.letters[now] = self.spelled(left, a, m) + self.spelled(right, m, b)
                out.append(self.letters[now])
            else:
                todo += [(right, m, b), (left, a, m)]
        return "".join(out)


def _lists(values: list) -> tuple[np.ndarray, np.ndarray]:
    """The items of some lists and where each list begins."""
    firsts = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int64)
    return np.concatenate(values) if len(values) else np.empty(0, np.int64), firsts


def chained(cost: np.ndarray, rank: np.ndarray, firsts: np.ndarray):
    """Each list's matrices multiplied from left to right; also the middle state at every place of a list."""
    sizes = np.diff(firsts)
    whole, order = cost[firsts[:-1]].copy(), rank[firsts[:-1]].copy()
    middles = np.zeros((len(cost), 4, 4), np.int8)
    for k in range(1, int(sizes.max(initial=0))):
        here = np.flatnonzero(sizes > k)
        place = firsts[here] + k
        whole[here], order[here], middles[place] = joined(whole[here], order[here], cost[place], rank[place])
    return whole, order, middles


def states(middles: np.ndarray, firsts: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after every place of lists that lead from ``p`` to ``q``."""
    before, after = np.zeros(len(middles), np.int64), np.zeros(len(middles), np.int64)
    sizes, q = np.diff(firsts), q.copy()
    for k in range(int(sizes.max(initial=0)) - 1, -1, -1):
        here = np.flatnonzero(sizes > k)
        place = firsts[here] + k
        after[place] = q[here]
        if k:
            q[here] = middles[place, p[here], q[here]]
            before[place] = q[here]
        else:
            before[place] = p[here]
    return before, after


def _pair_counts(rules: list[tuple[str, str]]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, found = Grammar(rules), Counter()
        for batch in batches:
            for sequence, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                short = grammar.compressed(sequence)
                for a, b in zip(short, short[1:]):
                    found[a, b] += n
        yield pa.record_batch({
            "a": pa.array([a for a, _ in found], pa.string()), "b": pa.array([b for _, b in found], pa.string()),
            "n": pa.array(list(found.values()), pa.int64())})
    return count


def learned_rules(sequences: DataFrame, rounds: int) -> list[tuple[str, str]]:
    """Rules of ``sequences (symbols, n)``. A round takes the most frequent pairs that share no symbol."""
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        counts = sequences.mapInArrow(_pair_counts(rules), "a string, b string, n long").groupBy("a", "b").agg(
            F.sum("n").alias("n"))
        often = counts.where("n >= 2").orderBy(F.desc("n"), "a", "b").limit(256).collect()
        taken: set[str] = set()
        for row in often:
            if row.a not in taken and row.b not in taken:
                taken |= {row.a, row.b}
                rules.append((row.a, row.b))
        if not often:
            break
    return rules


def _flat(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(matrix.reshape(-1).astype(np.int64)), 16).cast(pa.list_(pa.int64()))


def _initials(sequence: str) -> str:
    return sequence.translate(_ROLES)


_ROLES = str.maketrans(TRUNCATED + GONE, SOUND + SOUND)


def _illegal(initials: str) -> int:
    """Neighbours that are none of su, ua, au."""
    return len(initials) - 1 - sum(initials.count(legal) for legal in ("su", "ua", "au"))


def _evaluated(rules: list[tuple[str, str]]):
    """The matrix of each sequence, its first and last role, and how many neighbours are illegal."""
    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            if not batch.num_rows:
                continue
            sequences = batch.column(0).to_pylist()
            items, firsts = _lists([[grammar.number[c] for c in grammar.compressed(s)] for s in sequences])
            items = items.astype(np.int64)
            cost, rank, _ = chained(grammar.cost[items], grammar.rank[items], firsts)
            roles = [_initials(s) for s in sequences]
            yield pa.record_batch({
                "symbols": pa.array(sequences, pa.string()), "cost": _flat(cost), "rank": _flat(rank),
                "first": pa.array([r[0] for r in roles]), "last": pa.array([r[-1] for r in roles]),
                "illegal": pa.array([_illegal(r) for r in roles], pa.int64())})
    return evaluate


MATRIX = "cost array<long>, rank array<long>, first string, last string, illegal long"
PART = "array<struct<node: long, cost: array<long>, rank: array<long>, first: string, last: string, illegal: long>>"


def _parts(batch: pa.RecordBatch) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of the nodes, where each node's begin, and their matrices."""
    parts = batch.column("parts")
    firsts = np.r_[0, np.cumsum(np.diff(parts.offsets.to_numpy()))].astype(np.int64)
    flat = parts.flatten()
    cost, rank = (flat.field(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4) for c in ("cost", "rank"))
    return flat, firsts, cost, rank


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, firsts, cost, rank = _parts(batch)
        cost, rank, _ = chained(cost, rank, firsts)
        first, last = parts.field("first").to_pylist(), parts.field("last").to_pylist()
        illegal = parts.field("illegal").to_numpy(zero_copy_only=False).copy()
        begins = set(firsts.tolist())
        for k in range(1, len(first)):
            if k not in begins:
                illegal[k] += _illegal(last[k - 1] + first[k])
        yield pa.record_batch({
            "talk": batch.column("talk"), "node": batch.column("node"), "cost": _flat(cost), "rank": _flat(rank),
            "first": pa.array([first[k] for k in firsts[:-1]]), "last": pa.array([last[k - 1] for k in firsts[1:]]),
            "illegal": pa.array(np.add.reduceat(illegal, firsts[:-1]))})


def _descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, firsts, cost, rank = _parts(batch)
        _, _, middles = chained(cost, rank, firsts)
        p, q = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p", "q"))
        before, after = states(middles, firsts, p, q)
        yield pa.record_batch({
            "talk": batch.column("talk").take(pa.array(np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)))),
            "node": parts.field("node"), "p": pa.array(before.astype(np.int32)), "q": pa.array(after.astype(np.int32))})


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state each conversation ends in, its cost and what is inserted at its end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cost = np.array(batch.column("cost").to_pylist(), np.int64).reshape(-1, 4, 4)[:, 0]
        rank = np.array(batch.column("rank").to_pylist(), np.int64).reshape(-1, 4, 4)[:, 0]
        total = np.minimum(cost + END, NONE)
        last = (total * 4 + rank).argmin(1)
        yield pa.record_batch({
            "talk": batch.column("talk"), "node": batch.column("node"), "illegal": batch.column("illegal"),
            "cost": pa.array(total[np.arange(len(last)), last]), "p": pa.array(np.zeros(len(last), np.int32)),
            "q": pa.array(last.astype(np.int32)), "tail": pa.array([END_LETTERS[q] for q in last])})


def _audited(rules: list[tuple[str, str]]):
    """The edits of each piece, spelled out along its path."""
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            if not batch.num_rows:
                continue
            items, firsts = _lists(
                [[grammar.number[c] for c in grammar.compressed(s)] for s in batch.column("symbols").to_pylist()])
            items = items.astype(np.int64)
            _, _, middles = chained(grammar.cost[items], grammar.rank[items], firsts)
            p, q = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p", "q"))
            before, after = states(middles, firsts, p, q)
            letters = [grammar.spelled(int(k), int(a), int(b)) for k, a, b in zip(items, before, after, strict=True)]
            yield pa.record_batch({
                "talk": batch.column("talk"), "node": batch.column("node"), "p": batch.column("p"),
                "edits": pa.array(["".join(letters[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)], pa.string())})
    return audit


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the repaired conversations. A piece's edits come first, then its rows in order."""
    state, letters, place = 0, "", 0
    for batch in batches:
        out: dict[str, list] = {name: [] for name in ("talk", "at", "sub", "role", "edit", "digest")}
        columns = {name: batch.column(name).to_pylist() for name in ("talk", "at", "p", "edits", "role", "copies", "digest")}
        for talk, at, p, edits, role, copies, digest in zip(*columns.values(), strict=True):
            if edits is not None:
                state, letters, place = p, edits, 0
                tail = role is not None  # insertions after the last row
            rest, sub = len(letters) if edits is not None and tail else 0, 0
            copies = copies if edits is None else 0
            while copies or place < rest:
                letter = letters[place]
                place += 1
                if letter != "I":
                    copies -= 1
                if letter == "D":
                    continue
                new = role if letter == "K" else WANTED[state]
                for name, value in zip(out, (talk, at, sub, new, letter, None if letter == "I" else digest), strict=True):
                    out[name].append(value)
                state = STEP[state, new[0]]
                sub += 1
        yield pa.record_batch({
            "talk": pa.array(out["talk"], pa.string()), "at": pa.array(out["at"], pa.int64()),
            "sub": pa.array(out["sub"], pa.int32()), "role": pa.array(out["role"], pa.string()),
            "edit": pa.array(out["edit"], pa.string()), "digest": pa.array(out["digest"], pa.string())})


def talk_key(conv_id: Column) -> Column:
    """A string for each conversation, also for the one without an id."""
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit("n"))


def _described(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(talk_key(F.col("conv_id")).alias("talk"), F.col("turn").cast("long").alias("turn"),
                       role.alias("role"), text.alias("text"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return rows.select(
        "*", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))


def repaired_conversations(rows: DataFrame, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """Reports, one for each conversation, and the rows of the repaired conversations.

    ``rows`` has conv_id, turn, role and text; other columns are not looked at. A conversation's rows go by
    turn (nulls first), those of one turn by role, then by the text's first 64 characters and its digest; a
    null role or text is one space, and the rows without a conv_id are one conversation. A role counts by its
    first character: s, u or a in lower case; any other, or none, has no place in the grammar.

    Reports ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)``: numbers that lack among
    the turns (null turns left out, 0 if all are); rows by their first fault; neighbours whose initials are
    none of su, ua, au; the least cost and the edits, Keep, Rerole, Delete and Insert, by their initials: of
    the cheapest the least string. A conversation without a row has no report; an empty table has none.

    Repaired rows ``(conv_id, at, sub, role, text, edit)``: by ``at`` then ``sub`` in the conversation's order.
    """
    spark = rows.sparkSession
    on_executors(spark)
    n = shuffle_partitions(spark)
    described = _described(rows)
    names = rows.select(talk_key(F.col("conv_id")).alias("talk"), "conv_id").distinct()

    narrow = described.select("talk", "turn", "role", "digest", "blank", "cut", F.substring("text", 1, 64).alias("head"))
    same = narrow.groupBy("talk", "turn", "role", "head", "digest").agg(
        F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    # A null turn comes before all others.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = narrow.groupBy("talk", "digest").agg(F.min(turn).alias("earliest"))
    known = same.join(firsts, ["talk", "digest"]).withColumn("new", F.col("earliest") == turn).drop("earliest")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    gone = F.translate(kind, "suao", GONE)
    first = F.when(F.col("blank") | ~F.col("new"), gone).when(F.col("cut"), F.upper(kind)).otherwise(kind)
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int"))).alias("chunk")
    cut = known.select("*", first.alias("symbol"), gone.alias("gone"), chunk).withColumn(
        "here", F.least(F.lit(COPIES), F.col("copies") - F.col("chunk") * COPIES).cast("int"))
    symbols = F.when(F.col("chunk") == 0, F.concat("symbol", F.expr("repeat(gone, here - 1)"))).otherwise(
        F.expr("repeat(gone, here)"))
    order = [F.col("talk"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest"), F.col("chunk")]
    ordered = staged(cut.select("talk", "turn", "role", "head", "digest", "blank", "new", "cut", "chunk", F.col("here").alias("copies"),
                                symbols.alias("symbols")).repartitionByRange(n, *order).sortWithinPartitions(*order)
                     .withColumn("at", F.monotonically_increasing_id()))

    # Pieces are numbered densely enough for few levels: a partition's pieces, then the next partition's.
    inside = F.expr("at & 8589934591")
    most = ordered.agg(F.max(inside)).first()[0] or 0
    per = 1 << (int(most) // PIECE).bit_length()
    node = (F.shiftright("at", 33) * per + F.floor(inside / PIECE)).cast("long").alias("node")
    pieces = staged(ordered.groupBy("talk", node).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbols"))), lambda x: x.symbols), "").alias("symbols"),
        F.max("at").alias("at")))
    sequences = staged(pieces.groupBy("symbols").agg(F.count("*").alias("n")))
    rules = learned_rules(sequences, rounds)
    evaluated = staged(sequences.select("symbols").mapInArrow(_evaluated(rules), f"symbols string, {MATRIX}"))
    level = pieces.select("talk", "node", "symbols").join(evaluated, "symbols").drop("symbols")

    levels, wide = [], (ordered.agg(F.max(node)).first()[0] or 0) + 1
    while wide > 1:
        parent = F.floor(F.col("node") / FAN).cast("long")
        part = F.struct("node", "cost", "rank", "first", "last", "illegal")
        grouped = staged(level.groupBy("talk", parent.alias("parent")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
                         .select("talk", F.col("parent").alias("node"), F.col("parts").cast(PART).alias("parts")))
        levels.append(grouped)
        level = grouped.mapInArrow(_folded, f"talk string, node long, {MATRIX}")
        wide = -(-wide // FAN)
    roots = staged(level.mapInArrow(
        _rooted, "talk string, node long, illegal long, cost long, p int, q int, tail string"))
    paths = roots.select("talk", "node", "p", "q")
    for grouped in reversed(levels):
        paths = grouped.join(paths, ["talk", "node"]).mapInArrow(_descended, "talk string, node long, p int, q int")
    audits = staged(pieces.join(paths, ["talk", "node"]).select("talk", "node", "p", "q", "symbols").mapInArrow(
        _audited(rules), "talk string, node long, p int, edits string"))

    wholes = audits.groupBy("talk").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("node", "edits"))), lambda x: x.edits), "").alias("edits"))
    by_turn = ordered.groupBy("talk", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("copies") - (F.col("new") & (F.col("chunk") == 0)).cast("int")).otherwise(0)).alias("duplicate"),
        F.sum((~F.col("blank") & F.col("new") & F.col("cut") & (F.col("chunk") == 0)).cast("int")).alias("truncated"))
    wide_turn = F.col("turn").cast("decimal(20,0)")
    counts = by_turn.groupBy("talk").agg(
        F.coalesce((F.max(wide_turn) - F.min(wide_turn) + 1 - F.count("turn")).try_cast("long"), F.lit(0).cast("long")).alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
    reports = names.join(counts, "talk").join(roots.select("talk", "illegal", "cost", "tail"), "talk").join(wholes, "talk").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("edits", "tail").alias("audit"))

    none = {"role": "string", "copies": "int", "digest": "string"}
    edits = audits.select("talk", "node", F.lit(-1).cast("long").alias("at"), "p", "edits", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    lines = ordered.select("talk", node, "at", F.lit(None).cast("int").alias("p"), F.lit(None).cast("string").alias("edits"), "role", "copies", "digest")
    # Insertions at the end come as a piece of their own, behind the last one.
    last = pieces.groupBy("talk").agg(F.max("at").alias("at"))
    tails = roots.where("tail <> ''").join(last, "talk").select(
        "talk", F.lit(-1).cast("long").alias("node"), F.col("at") + 1, F.col("q").alias("p"), F.col("tail").alias("edits"),
        F.lit("").alias("role"), F.lit(0).alias("copies"), F.lit(None).cast("string").alias("digest"))
    kept = edits.union(lines).union(tails).repartition(n, "talk", "node").sortWithinPartitions("talk", "node", "at").mapInArrow(
        _edited, "talk string, at long, sub int, role string, edit string, digest string")
    # A kept row is the first of its role and text, so talk and digest name it.
    texts = described.where(~F.col("blank")).groupBy("talk", "digest").agg(F.first("text").alias("text"))
    repaired = kept.join(texts, ["talk", "digest"], "left").join(names, "talk").select(
        "conv_id", "at", "sub", "role", F.coalesce("text", F.lit("")).alias("text"), "edit")
    return reports, repaired


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """``(talk, sha256)`` of each conversation's ``role:text`` lines, joined by line breaks.

    A digest takes the texts one after the other, so a conversation's rows pass one task; they stream through it.
    """
    n = shuffle_partitions(repaired.sparkSession)
    rows = repaired.select(talk_key(F.col("conv_id")).alias("talk"), "at", "sub", "role", "text")
    dealt = rows.repartition(n, "talk").sortWithinPartitions("talk", "at", "sub")
    return dealt.mapInArrow(_digested, "talk string, sha256 string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, hashlib.sha256()
    for batch in batches:
        talks, digests = [], []
        for talk, role, text in zip(*(batch.column(c).to_pylist() for c in ("talk", "role", "text")), strict=True):
            if talk == now:
                digest.update(b"\n")
            else:
                if now is not None:
                    talks.append(now)
                    digests.append(digest.hexdigest())
                now, digest = talk, hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
        yield pa.record_batch({"talk": pa.array(talks, pa.string()), "sha256": pa.array(digests, pa.string())})
    if now is not None:
        yield pa.record_batch({"talk": pa.array([now]), "sha256": pa.array([digest.hexdigest()])})
