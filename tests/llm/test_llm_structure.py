"""Conversation repair, collocations and near-duplicate vectors against plain versions on small tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import conversation_repair as repair
from lodeseek.llm import lattice_dedup as lattice
from lodeseek.llm import phrases

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
TALKS = "conv_id long, turn long, role string, text string, talk string, node int, symbols int, at int"


def plain_repair(rows):
    """(conv_id, turn, role, text) of one conversation -> the report and the lines, by Dijkstra-free dynamic programming on strings."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else (
            "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
        faults.append(fault)
    best = {0: (0, "", ())}

    def relax(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def with_insertions(table):
        table = dict(table)
        for _ in range(4):
            for state, (cost, audit, lines) in list(table.items()):
                relax(table, STEP[state, WANT[state][0]], (cost + 2, audit + "I", (*lines, f"{WANT[state]}:")))
        return table

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in with_insertions(best).items():
            relax(after, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if (state, role[:1]) in STEP:
                relax(after, STEP[state, role[:1]], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            relax(after, STEP[state, WANT[state][0]], (cost + 2 + extra, audit + "R", (*lines, f"{WANT[state]}:{text}")))
        best = after
    cost, audit, lines = min(v for k, v in with_insertions(best).items() if k in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    n = Counter(faults)
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit), list(lines)


def talks(seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.choice([1, 2, 5, 9, 20])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "agent", "User"])
            text = rng.choice(["Hi.", "Oh?", "no end", " \n ", "", None, f"Own {conv} {turn}!", "end. \t", "é"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
            if rng.random() < 0.15:
                rows += [rows[-1]] * rng.choice([1, 3])
    return rows


def made(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], TALKS)


def check_talks(spark, rows, **options):
    reports, repaired = repair.repaired_conversations(made(spark, rows), **options)
    found = {r.conv_id: tuple(r)[1:] for r in reports.collect()}
    lines = defaultdict(list)
    for r in sorted(repaired.collect(), key=lambda r: (r.at, r.sub)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    digests = {r.talk: r.sha256 for r in repair.conversation_digests(repaired).collect()}
    whole = defaultdict(list)
    for r in rows:
        whole[r[0]].append(r)
    assert set(found) == set(whole)
    for conv, own in whole.items():
        report, text = plain_repair(own)
        assert found[conv] == report, (conv, own)
        assert lines[conv] == text
        key = "n" if conv is None else f"c{conv}"
        if text:
            assert digests[key] == hashlib.sha256("\n".join(text).encode()).hexdigest()
        else:
            assert key not in digests


def test_conversations_with_nulls_ties_and_copies(spark):
    check_talks(spark, talks())


def test_long_conversation_in_pieces_and_levels(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 3)
    monkeypatch.setattr(repair, "FAN", 2)
    monkeypatch.setattr(repair, "COPIES", 2)
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", "same.", ""])) for k in range(150)]
    check_talks(spark, rows + [(2, 0, "user", "x.")] * 7, rounds=3)


@pytest.mark.parametrize("rounds", [0, 1, 20])
def test_rules_change_no_result(spark, rounds):
    check_talks(spark, talks(9)[:120], rounds=rounds)


def test_spelled_ropes_of_deep_rules():
    grammar = repair.Grammar([("s", "u"), ("a", "u"), ("", ""), ("", ""), ("u", "1")])
    plain = repair.Grammar([])
    for sequence in ("suauau", "auauau1", "uuu11au", "osuau1S"):
        short = grammar.compressed(sequence)
        for p, q in itertools.product(range(4), range(4)):
            got = []
            for g, s in ((grammar, short), (plain, sequence)):
                items = np.array([g.number[c] for c in s])
                firsts = np.array([0, len(s)])
                cost, _, middles = repair.chained(g.cost[items], g.rank[items], firsts)
                before, after = repair.states(middles, firsts, np.array([p]), np.array([q]))
                text = "".join(g.spelled(int(k), int(a), int(b)) for k, a, b in zip(items, before, after)) if cost[0, p, q] < repair.NONE else None
                got.append((int(cost[0, p, q]), text))
            assert got[0] == got[1]


def test_empty_and_megabyte_conversations(spark):
    reports, repaired = repair.repaired_conversations(made(spark, []))
    assert reports.count() == repaired.count() == 0
    check_talks(spark, [(1, 0, "user", "w " * 500_000 + "."), (1, 1, "assistant", " " * 1_000_000), (1, 2, "assistant", "." + "\n" * 1_000_000)])


# Collocations


def plain_collocations(rows, least, top):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i:i + k])] += 1
    often = {k: v for k, v in count.items() if v >= least}
    out = defaultdict(list)
    for (lang, ws), a in often.items():
        if len(ws) == 1:
            continue
        score, _, l, r = min(
            (2_000_000 * a // (count[lang, ws[:k]] + count[lang, ws[k:]]), k, count[lang, ws[:k]], count[lang, ws[k:]])
            for k in range(1, len(ws)))
        covered = any(
            len(big) > len(ws) and where == lang and 100 * f >= 80 * a
            and any(big[i:i + len(ws)] == ws for i in range(len(big) - len(ws) + 1))
            for (where, big), f in often.items() if len(big) > len(ws))
        if not covered:
            out[lang].append((-score, -a, " ".join(ws).encode(), l, r))
    return {
        (lang, rank, phrase.decode(), -a, l, r, total[lang], -score)
        for lang, found in out.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)}


DOCS = "doc_id long, text string, lang string, id long, word string, g long, f long"


def phrase_rows(seed=4, count=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "and", "é", "a-b", "x\x00y", "日本", "it"]
    rows = [(" ".join(rng.choices(words, k=rng.choice([1, 3, 30, 90]))) + rng.choice([".", "\n", "", ", "]) + "in the end of it", rng.choice(["en", "de", None, ""]))
            for _ in range(count)]
    return rows + [(None, "en"), ("", None), (" \t ", "en"), ("a.b,c;d:e!f?g\x0bh\x0ci\rj", "en"), rows[0], rows[0]]


@pytest.mark.parametrize("top", [7, 2000])
def test_collocations_against_counting(spark, top):
    rows = phrase_rows()
    docs = spark.createDataFrame([(k, *r, 1, "w", 2, 3) for k, r in enumerate(rows)], DOCS)
    found = phrases.collocations(docs, least=4, top=top)
    assert {tuple(r) for r in found.collect()} == plain_collocations(rows, 4, top)


def test_collocations_of_small_slices(spark, monkeypatch):
    for name, value in (("SLICE", 300), ("RUN", 16), ("PENDING", 50), ("PART_BYTES", 64), ("LEAST_BITS", 16)):
        monkeypatch.setattr(phrases, name, value)
    rows = phrase_rows(6, 40)
    docs = spark.createDataFrame([(k, *r, 1, "w", 2, 3) for k, r in enumerate(rows)], DOCS)
    found = phrases.collocations(docs, least=3, top=100)
    assert {tuple(r) for r in found.collect()} == plain_collocations(rows, 3, 100)


def test_collocations_of_nothing_and_of_megabytes(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.collocations(empty).count() == 0
    rows = [("a b " * 300_000, "en"), (" " * 1_000_000 + "x", "en"), ("y" * 1_000_000, "de")]
    docs = spark.createDataFrame([(k, *r, 1, "w", 2, 3) for k, r in enumerate(rows)], DOCS)
    found = {r.phrase: r for r in phrases.collocations(docs).collect()}
    assert set(found) == {"a b a b", "b a b a"}
    assert found["a b a b"].a == 299_999 and found["a b a b"].n == 600_001


def test_filters_lose_nothing():
    rng = np.random.default_rng(2)
    for size, part_bits, n in itertools.product((2, 3, 4), (0, 3, 7), (1, 5, 5000)):
        ids = [rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64) for _ in range(size)]
        g, others, counts = phrases.summed(phrases.permuted(ids), ids[1:], rng.integers(1, 700, n))
        part = int(g[0] >> np.uint64(64 - part_bits)) if part_bits else 0
        mine = (g >> np.uint64(64 - part_bits)) == part if part_bits else np.ones(len(g), bool)
        g, others, counts = g[mine], [c[mine] for c in others], counts[mine]
        got = phrases.Filter.unpacked(part, part_bits, size, phrases.Filter.packed(g, others, counts, part_bits))
        assert (got[0] == g).all() and all((a == b).all() for a, b in zip(got[1], others)) and (got[2] == counts).all()
        known = set(map(tuple, np.stack(ids, 1).tolist()))
        assert set(map(tuple, np.stack([phrases.restored(*got[:2]), *got[1]], 1).tolist())) <= known


def test_entries_that_agree_in_their_number_only():
    g = np.array([5, 5, 5, 2], np.uint64)
    other = [np.array([1, 9, 1, 1], np.uint64)]
    got = phrases.summed(g, other, np.array([1, 1, 1, 4]))
    assert got[0].tolist() == [2, 5, 5] and got[1][0].tolist() == [1, 1, 9] and got[2].tolist() == [4, 2, 1]


# Near-duplicate vectors


def test_lattice_points_are_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    point = lattice.lattice_point(x)
    whole = (point == np.round(point)).all(1)
    halves = (point * 2 % 2 == 1).all(1)
    assert (whole | halves).all() and (point.sum(1) % 2 == 0).all()
    own = ((x - point) ** 2).sum(1)
    for step in lattice.NEIGHBOURS:
        assert (own <= ((x - point - step) ** 2).sum(1) + 1e-9).all()
    assert len(np.unique(lattice.NEIGHBOURS, axis=0)) == 240 and np.allclose((lattice.NEIGHBOURS ** 2).sum(1), 2)


def plain_links(rows, cosine):
    sound = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        sound[vec_id] = min(sound.get(vec_id, (str(label), v)), (str(label), v))
    near, ids = defaultdict(set), {r[0] for r in rows if r[0] is not None}
    for a, b in itertools.combinations(sound, 2):
        (la, x), (lb, y) = sound[a], sound[b]
        if la == lb and len(x) == len(y):
            x, y = np.float32(x).astype(float), np.float32(y).astype(float)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                near[a].add(b)
                near[b].add(a)
    out = {}
    for start in sorted(ids):
        if start in out:
            continue
        group, todo = {start}, [start]
        while todo:
            for other in near[todo.pop()] - group:
                group.add(other)
                todo.append(other)
        for member in group:
            out[member] = (len(near[member]), min(group), member == min(group))
    return out


VECTORS = "vec_id long, label int, embedding array<float>, id string, rep int, cell int, component_id int"


def near_vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows, number = [], itertools.count(10)
    for cluster in range(12):
        centre = rng.normal(size=32)
        for spread in rng.choice([0.0, 0.02, 0.05, 0.2], 8):
            v = (centre + rng.normal(size=32) * spread) * rng.choice([1, 5, 0.001])
            rows.append((next(number), int(cluster % 3), [float(np.float32(x)) for x in v]))
    chain = rng.normal(size=32)
    for _ in range(30):  # neighbours link, ends do not
        chain = chain + rng.normal(size=32) * 0.25
        rows.append((next(number), 5, [float(np.float32(x)) for x in chain]))
    same = rows[0]
    rows += [(next(number), same[1], same[2]) for _ in range(40)] + [(next(number), 9, same[2]), (next(number), None, same[2])]
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1.0] * 31, [1.0] * 31, [-0.0] + [1.0] * 30]
    rows += [(next(number), 1, v) for v in odd] + [(None, 1, same[2]), same, (same[0], 7, rows[3][2])]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_near_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rows = near_vectors()
    found = lattice.lattice_dedup(spark.createDataFrame([(*r, "i", 1, 2, 3) for r in rows], VECTORS), cosine=0.93)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert {r.vec_id: tuple(r)[1:] for r in found.collect()} == plain_links(rows, 0.93)


def test_links_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(1500):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        rows += [(2 * k, 1, x.tolist()), (2 * k + 1, 1, (0.932 * x + np.sqrt(1 - 0.932 ** 2) * y).tolist())]
    found = lattice.lattice_dedup(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), cosine=0.93)
    assert found.where(F.col("n_links") == 1).count() >= 0.995 * 3000
    assert found.where(F.col("n_links") > 1).count() == 0


def test_no_vectors(spark):
    assert lattice.lattice_dedup(spark.createDataFrame([], VECTORS)).count() == 0
