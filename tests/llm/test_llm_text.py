"""Text operators against brute force on small tables with nulls, ties, copies and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n long, part int, label string, places binary, found_id long"


def sample(seed=3, count=70):
    rng = random.Random(seed)
    words = ["the", "of", "and", "ÉTÉ", "x y", "Zürich", "日本", "🙂🙂"] + [f"w{k}" for k in range(150)]
    passage = " ".join(rng.choices(words, k=40))
    rows = []
    for k in range(count):
        text = " ".join(rng.choices(words, k=rng.choice([1, 3, 4, 5, 30, 80])))
        kind = k % 7
        if kind == 1 and rows:
            text = rows[-1][1] or ""
        elif kind == 2 and rows:
            cut = (rows[-1][1] or "").split(" ")
            cut[len(cut) // 2] = "changed"
            text = "\t".join(cut).upper()
        elif kind == 3:
            text = f"{text}\n{passage}\n{text}"
        rows.append([k, text, f"s{k % 2}"])
    rows[5][1] = None
    rows[6][1] = ""
    rows[8][1] = " \t\n "
    rows[9][1] = "🙂"
    rows[10][2] = None
    rows[11][1] = passage + " " + " ".join(["same"] * 3000)
    return [tuple(r) for r in rows]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "l", b"p", 3) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def grams(text):
    w = WORD.findall(low(text or ""))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(rows, percent=80):
    sets, parent = [(d, grams(t)) for d, t, *_ in rows], {d: d for d, *_ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return sorted((d, len(s), top(d)) for d, s in sets)


def test_ngram_join(spark):
    from lodeseek.llm.ngram_join import ngram_jaccard_join

    rows = sample()
    rows += [rows[3], (4, "another text of the same id as before", "s0")]
    got = [tuple(r) for r in ngram_jaccard_join(table(spark, [*rows, (None, rows[3][1], "s")])).collect()]
    assert sorted(r for r in got if r[0] is not None) == components(rows)
    assert [r for r in got if r[0] is None] == [(None, len(grams(rows[3][1])), None)]


def test_ngram_join_of_nothing(spark):
    from lodeseek.llm.ngram_join import ngram_jaccard_join

    result = ngram_jaccard_join(empty(spark))
    assert result.collect() == [] and result.columns == ["doc_id", "n_shingles", "component_id"]


def test_linked_by_trie_is_what_pairs_say():
    import numpy as np

    from lodeseek.llm.ngram_join import linked, parity_bits, possible

    rng = random.Random(1)
    for _ in range(60):
        base = [rng.sample(range(400), rng.choice([4, 20, 60])) for _ in range(3)]
        sets = []
        for _ in range(rng.choice([2, 5, 25])):
            own = set(rng.choice(base))
            for _ in range(rng.choice([0, 1, 5])):
                own.discard(next(iter(own)))
                own.add(rng.randrange(400))
            sets.append(np.array(sorted(own), np.uint64))
        parent = list(range(len(sets)))

        def top(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, x in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(x, sets[j]))
                if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                    parent[max(top(i), top(j))] = min(top(i), top(j))
        wanted = [top(k) for k in range(len(sets))]
        found = list(range(len(sets)))
        for a, b in linked(sets, 80):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
            x, y = found[a], found[b]
            found = [min(x, y) if f in (x, y) else f for f in found]
        assert found == wanted
        maps = [np.frombuffer(parity_bits(s), np.uint64) for s in sets]
        classes = possible(np.array([len(s) for s in sets]), maps, 80)
        assert all(classes[i] == classes[wanted[i]] for i in range(len(sets)))


@pytest.mark.parametrize("windows", [(104, 5, 10), (52, 6, 5)])
def test_chains_are_linked_in_every_order(windows):
    from itertools import permutations

    import numpy as np

    from lodeseek.llm.ngram_join import linked, parity_bits, possible

    size, count, step = windows  # neighbours of the chain link, others don't
    chain = [np.arange(step * k, step * k + size, dtype=np.uint64) for k in range(count)]
    chain += [chain[0] + np.uint64(10_000), chain[1] + np.uint64(10_000)]  # another class
    orders = list(permutations(range(count)))
    for order in orders if count < 6 else orders[::5]:
        sets = [chain[k] for k in (*order, count, count + 1)]
        group = list(range(len(sets)))
        for a, b in linked(sets, 80):
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group]
        assert len(set(group[:count])) == 1 and len(set(group[count:])) == 1 and len(set(group)) == 2, order
        maps = [np.frombuffer(parity_bits(s), np.uint64) for s in sets]
        classes = possible(np.full(len(sets), size), maps, 80)
        assert len(set(classes[:count])) == 1 and classes[count] == classes[count + 1], order


def test_blocks_meet_all_pairs():
    from lodeseek.llm.ngram_join import _blocks

    assert _blocks(0, 1) == [(0, 0)]
    for a in range(4):
        for b in range(4):
            assert set(_blocks(a, 4)) & set(_blocks(b, 4))


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    from lodeseek.llm import ngram_join

    monkeypatch.setattr(ngram_join, "MAPS", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        own = list(base)
        own[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(own), "s"))
    got = sorted(tuple(r) for r in ngram_join.ngram_jaccard_join(table(spark, rows)).collect())
    assert got == components(rows)


def removed(rows, window=20):
    seen, out = {}, []
    for d, t, *_ in sorted(rows):
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k:k + window]), (d, k))
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] < (d, k):
                gone[k:k + window] = [True] * window
        kept = None if t is None else " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [20, 6])
def test_substring_dedup(spark, window):
    from lodeseek.llm.substring_dedup import substring_dedup

    rows = sample(5)
    frame = table(spark, rows).withColumnRenamed("label", "n_words")
    result = substring_dedup(frame, window=window)
    assert sorted(result.columns) == sorted([*frame.columns, "n_removed"])
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in result.collect()]
    assert sorted(got, key=repr) == removed(rows, window)


def test_substring_dedup_without_ids_or_rows(spark):
    from lodeseek.llm.substring_dedup import substring_dedup

    text = " ".join(f"w{k}" for k in range(30))
    rows = substring_dedup(table(spark, [(1, text, "s"), (1, text, "s"), (None, text, "s"), (2, text, "s")])).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in rows) == [(-1, 30, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30)]
    assert substring_dedup(empty(spark)).collect() == []


def test_covers():
    from lodeseek.llm.substring_dedup import COVERS

    for period, places in COVERS.items():
        for i in range(period):
            for j in range(period):
                assert any((i + d) % period in places and (j + d) % period in places for d in range(period))


def lines_left(rows, ratio, least):
    texts, often = defaultdict(set), defaultdict(Counter)
    for _, t, s, *_ in rows:
        texts[s].add(t)
    for s, own in texts.items():
        for t in own:
            often[s].update({x for x in (t or "").split("\n") if x.strip(" ")})
    out = []
    for d, t, s, *_ in rows:
        if t is None:
            out.append((d, 0, 0, None))
            continue
        every = t.split("\n")
        kept = [x for x in every if s is None or not x.strip(" ") or often[s][x] < least or often[s][x] <= ratio * len(texts[s])]
        out.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 1000])
def test_line_dedup(spark, least):
    from lodeseek.llm.line_dedup import line_dedup

    rows = [(d, None if t is None else f"menu\n{t}\n\nmenu" if d % 3 else t, s) for d, t, s in sample(6)] + [(3, "menu", "s1")]
    frame = table(spark, rows).withColumnRenamed("label", "lines").withColumnRenamed("part", "host")
    result = line_dedup(frame, max_ratio=0.1, least=least)
    assert sorted(result.columns) == sorted([*frame.columns, "n_lines", "n_dropped"])
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in result.collect()]
    assert sorted(got, key=repr) == lines_left(rows, 0.1, least)
    assert any(g[2] for g in got) == (least == 2)


def test_line_dedup_of_small_hosts_and_copies(spark):
    from lodeseek.llm.line_dedup import line_dedup

    rows = [(k, f"menu\nbody {k}", "nine") for k in range(9)] + [(20, "only\none", "one"), (21, None, "none")]
    rows += [(30 + k, f"text {k // 2}\nof copies {k // 2}", "twice") for k in range(12)]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == lines_left(rows, 0.1, 2)
    texts = {d: t for d, _, _, t in got}
    assert texts[0] == "body 0" and texts[20] == "only\none" and texts[30] == texts[31] == "text 0\nof copies 0"


def test_line_dedup_of_megabytes(spark):
    from lodeseek.llm.line_dedup import line_dedup

    rows = [(1, "menu\n" + "x" * 1_000_000, "s"), (2, "menu\n" + "\n".join(map(str, range(100_000))), "s"), (3, "\n" * 1_000_000, "s")]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == lines_left(rows, 0.1, 2)


def test_line_dedup_of_nothing(spark, monkeypatch):
    from lodeseek.llm import line_dedup as module

    monkeypatch.setattr(module, "BROADCAST_LINES", -1)
    assert module.line_dedup(empty(spark)).collect() == []
    rows = [(k, "menu\nbody %d" % k, "s") for k in range(12)]
    assert {r.text for r in module.line_dedup(table(spark, rows)).collect()} == {"body %d" % k for k in range(12)}


@pytest.mark.parametrize("held", [500_000, -1])
def test_copies_keep_their_text_in_the_pipeline(spark, monkeypatch, held):
    import corpus_pipeline

    from lodeseek.llm import line_dedup as module

    monkeypatch.setattr(module, "BROADCAST_LINES", held)
    rows = [(k, "menu\nbody %d" % (k if k < 40 else 99), "s") for k in range(60)]  # a third are copies
    rows += [(100 + k, "menu\nother %d" % max(k, 1), "t") for k in range(12)] + [(200, None, "t")]
    frame = table(spark, rows)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate_lines(spark, frame, "").collect()}
    assert got == {d: t and t.removeprefix("menu\n") for d, t, _ in rows}


def test_fingerprints(spark):
    from pyspark.sql import functions as F

    from lodeseek.llm.spot_signatures import edited_fingerprints, fingerprint, likeness

    rows = [r for r in sample(8)]
    result = edited_fingerprints(table(spark, [*rows, (None, "no id here at all", "s")]))
    got = result.select(
        "doc_id", "n_chars", "edited_text", fingerprint(F.col("signatures")).alias("own"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("other")).collect()
    texts = {d: t or "" for d, t, *_ in rows}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    own = {r.doc_id: r.own for r in got}
    for r in got:
        t = texts.get(r.doc_id, "no id here at all")
        k = len(t) // 3
        assert r.n_chars == len(t)
        assert r.edited_text == t[: len(t) - k] + (texts[after[r.doc_id]][:k] if r.doc_id is not None else "")
        assert 0 <= r.near <= 1 and 0 <= r.other <= 1
    for a in texts:
        for b in texts:
            if texts[a] == texts[b]:
                assert own[a] == own[b]
    assert edited_fingerprints(empty(spark)).collect() == []


def spots(text):
    from lodeseek.llm.spot_signatures import COMMON

    common = set(COMMON.split())
    w = re.findall(r"[^\W_]+", (text or "").lower())
    is_common = [len(x) <= 2 or x in common for x in w]
    found = {("^", *w[:2])} if w else set()
    for k, x in enumerate(w):
        chain = [y for y, c in zip(w[k + 1:], is_common[k + 1:], strict=True) if not c][:2]
        if is_common[k] and len(chain) == 2:
            found.add((x, *chain))
    return found


def test_signatures_and_near_documents(spark):
    from pyspark.sql import functions as F

    from lodeseek.llm.spot_signatures import near_documents, with_signatures

    rng = random.Random(2)
    rows = []
    for k in range(40):
        words = rng.choices(["the", "and", "of", "nicht"], k=30) + [f"word{rng.randrange(300)}" for _ in range(40)]
        rng.shuffle(words)
        rows.append((k, "The, ".join([" ".join(words)]), "s"))
        if k % 4 == 1:
            rows[-1] = (k, rows[-2][1] + " end", "s")
        if k % 9 == 8:
            rows[-1] = (k, rows[-2][1], "s")
    rows += [(50, None, "s"), (51, "", "s"), (None, rows[0][1], "s")]
    frame = table(spark, rows)
    sizes = {r.doc_id: len(r.found) for r in with_signatures(frame, F.col("text"), "found").collect() if r.doc_id is not None}
    sets = {d: spots(t) for d, t, *_ in rows if d is not None}
    assert sizes == {d: len(s) for d, s in sets.items()}
    first = {}
    for d in sorted(sets):
        first.setdefault(frozenset(sets[d]), d)
    names = sorted(d for s, d in first.items() if s)
    wanted = {(a, b) for a in names for b in names
              if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in near_documents(frame).collect()} == wanted and wanted


LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"


def license_units(path, text):
    """Lines, runs of two to four lines, paragraphs, comment blocks, whole licence files."""
    lines = text.split("\n")
    units = ["\n".join(lines[i:i + n]) for i in range(len(lines)) for n in range(1, 5)]
    for keep in (lambda x: re.search(r"[^\W_]", x), lambda x: re.match(r"[ \t]*(#|//|/?\*|--|;|%|<!--)", x)):
        for good, group in itertools.groupby(lines, key=lambda x: bool(keep(x))):
            units += ["\n".join(group)] if good else []
    return units + [text] * bool(re.search(LICENSE_NAME, path))


def scan(files, templates, threshold):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    idf = lambda w: math.log((1 + len(files)) / (1 + sum(w in words(t) for t in files.values()))) + 1

    def vector(text):
        v = {w: n * idf(w) for w, n in Counter(words(text)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    known = [(name, vector(t)) for name, t in templates]
    own = {}
    for path, text in files.items():
        units = [vector(x) for x in license_units(path, text) if words(x)]
        scores = [(-round(sum(x * t.get(w, 0) for w, x in u.items()), 9), name) for u in units for name, t in known]
        best = min((s for s in scores if -s[0] >= threshold), default=None)
        if best:
            own[path] = (best[1], -best[0])
    out = {}
    for path in files:
        out[path] = (own[path][0], "declared", own[path][1]) if path in own else (None, None, None)
        at = path.rpartition("/")[0]
        while path not in own:
            near = [(-own[p][1], own[p][0]) for p in own if p.rpartition("/")[0] == at and re.search(LICENSE_NAME, p)]
            if near:
                out[path] = (min(near)[1], "inherited", -min(near)[0])
            if near or not at:
                break
            at = at.rpartition("/")[0]
    return out


def scanned(frame, **options):
    from lodeseek.llm.license_scan import license_scan

    return {r.path: (r.license, r.basis, r.score) for r in license_scan(frame, **options).collect()}


def same_scan(got, expected):
    assert {p: x[:2] for p, x in got.items()} == {p: x[:2] for p, x in expected.items()}
    assert all(x[2] == pytest.approx(expected[p][2], abs=2e-9) for p, x in got.items() if x[2] is not None)


def test_license_scan(spark):
    from lodeseek.llm.license_scan import TEMPLATES

    files = {
        "LICENSE": "Released under the MIT License.", "a/LICENSE.txt": "words\nLicensed under the Apache License, Version 2.0.",
        "a/b/c/x.py": "import os\nof the and", "a/b/LICENSE": "no licence here", "a/b/y.py": "Licensed under CC BY-NC 4.0.",
        "q/z.py": "", "q/r/LICENSE-2": "This work is licensed under\nthe GNU General Public License,\nversion 3.",
        "q/r/t.py": "under the version of this public work", "top.py": "free software is free",
    }
    rows = [(p, t) for p, t in files.items()] + [("q/z.py", None), (None, "Released under the MIT License.")]
    frame = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "path string, text string, license string, number int, score double")
    got = scanned(frame)
    same_scan(got, scan(files, TEMPLATES, 0.8))
    assert got["a/b/c/x.py"][:2] == ("Apache-2.0", "inherited") and got["q/r/t.py"][:2] == ("GPL-3.0", "inherited")
    assert scanned(frame.limit(0)) == {}


MIT_FILE = """MIT License

Copyright (c) 2021 Ann Example

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE_HEADER = """/*
 * Copyright 2020 Acme
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
class Ship { int speed; }
"""
APACHE_FILE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
GPL_HEADER = """# ship.py: moves ships
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful.
speed = 3
"""
BSD_FILE = """Copyright (c) 2019, Bob Example

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_license_scan_of_usual_files_and_wrapped_headers(spark):
    from lodeseek.llm.license_scan import TEMPLATES

    files = {
        "m/LICENSE": MIT_FILE, "m/src/a.py": "x = 1", "ap/Ship.java": APACHE_HEADER, "ap/LICENSE": APACHE_FILE,
        "g/ship.py": GPL_HEADER, "g/old.py": GPL_HEADER.replace("version 3", "version 2"),
        "g/less.py": GPL_HEADER.replace("General", "Lesser General"), "g/COPYING": "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n",
        "b2/LICENSE.md": BSD_FILE, "b3/LICENSE.md": BSD_FILE + BSD_THIRD,
        "w/a.c": "int x;\n// Licensed under the Apache\n// License, Version 2.0\nint y;",
        "w/b.c": "Released under\r\nthe MIT\r\nLicense\r\n", "w/c.c": "Released\n\nunder the\nsea\nand the License\nof MIT",
        "n/plain.txt": "The ship\nis free and the licence\nof its master was public.", "n/void": "\n\n \n",
    }
    files |= {f"p/f{k}.txt": f"The ship {k} is under way\nand the version of the file" for k in range(40)}
    frame = spark.createDataFrame(list(files.items()), "path string, text string")
    got = scanned(frame)
    same_scan(got, scan(files, TEMPLATES, 0.8))
    expected = {
        "m/LICENSE": "MIT", "m/src/a.py": "MIT", "ap/Ship.java": "Apache-2.0", "ap/LICENSE": "Apache-2.0", "g/ship.py": "GPL-3.0",
        "g/old.py": "GPL-2.0", "g/COPYING": "GPL-3.0", "b2/LICENSE.md": "BSD-2-Clause", "b3/LICENSE.md": "BSD-3-Clause",
        "w/a.c": "Apache-2.0", "w/b.c": "MIT", "w/c.c": None, "n/plain.txt": None, "n/void": None, "p/f0.txt": None,
    }
    assert {p: got[p][0] for p in expected} == expected


def test_license_scan_of_very_long_texts(spark):
    head = "// Released under\n// the MIT License\n"
    texts = {"blank": "\n" * 2_000_000 + head, "wide": head + " " * 2_000_000 + "x", "signs": "*" * 1_000_000 + "\n" + head,
             "words": "License of the ship " * 100_000 + "\n" + head, "lines": head + "under the License\n" * 20_000, "one": "x" * 2_000_000}
    got = scanned(spark.createDataFrame(list(texts.items()), "path string, text string"))
    assert {p: x[0] for p, x in got.items()} == {**dict.fromkeys(texts, "MIT"), "one": None}


@pytest.mark.parametrize("held", [200_000, -1])
def test_license_scan_knows_how_common_other_words_are(spark, monkeypatch, held):
    from lodeseek.llm import license_scan as module

    monkeypatch.setattr(module, "BROADCAST_WORDS", held)
    files = [(f"d/f{k}.py", f"Acme file {k}\nuse it") for k in range(400)]
    files += [("d/x.py", "Acme, released under the MIT License"), ("d/y.py", "Licensed under the Apache License, Version 2.0 Acme")]
    files += [("d/z.py", "unseen words released under some License")]
    frame = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.license, r.basis, r.score) for r in module.license_scan(frame).collect()}
    assert got["d/x.py"][:2] == ("MIT", "declared") and got["d/y.py"][:2] == ("Apache-2.0", "declared")
    assert got["d/z.py"] == (None, None, None)

    def weight(word):
        words = [set(re.findall(r"[^\W_]+", t.lower())) for _, t in files]
        return math.log((1 + len(files)) / (1 + sum(word in w for w in words))) + 1

    template = sum(weight(w) ** 2 for w in ("released", "under", "the", "mit", "license"))
    assert got["d/x.py"][2] == pytest.approx(math.sqrt(template / (template + weight("acme") ** 2)), abs=1e-8)


def test_words_are_cut_as_the_pattern_says():
    import pyarrow as pa

    from lodeseek.llm.words import Words

    texts = ["a  b\x0bc\x1cd", None, "", "é ü x", " ", "A a", "x" * 3_000_000 + " y " + "x" * 3_000_000]
    words = Words(pa.array(texts[:1] + texts)[1:])
    assert list(words.at[1:] - words.at[:-1]) == [len(WORD.findall(t or "")) for t in texts]
    plain, folded = words.hashes(), words.hashes(folded=True)
    at = words.at[5]
    assert folded[at] == folded[at + 1] and plain[at] != plain[at + 1] and plain[0] == plain[at + 1]
    last = words.at[6]
    assert plain[last] == plain[last + 2] != plain[last + 1]


def test_components(spark):
    from lodeseek.llm.components import connected_components

    chain = [(k, k + 1) for k in range(10, 60)]
    star = [(100, k) for k in range(101, 160)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (60, 5)], "a long, b long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert got == {**{k: 5 for k in [5, *range(10, 61)]}, **{k: 100 for k in range(100, 160)}}
    assert connected_components(links.limit(0)).collect() == []


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    import struct

    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


ODD = ["", None, "a", "It's 3 o'clock!  \n\n x\t", "x" * 5000, "   a   b", "a <|endoftext|> b", "日本語 🙂 é", "\x1c \x1d"]


def test_pieces_are_the_tokenizers_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodeseek.llm.packing import pack, sequences, token_pieces

    rows = [(d, t, "s") for d, t, _ in sample(9)] + [(1000 + k, t, "s") for k, t in enumerate(ODD)]
    rows += [(2000, "word " * 3000, "s"), (2000, "word " * 3000, "s"), (None, "no id", "s")]
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for d, t, _ in rows:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 2]
        lo, hi, number = 0, (len(ids) - 1) % 64 + 1, 0
        while lo < len(ids):
            wanted[(d, number, lo, hi - lo, crc(ids[lo:hi]))] += 1
            lo, hi, number = hi, hi + 64, number + 1
    pieces = token_pieces(table(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), max_tokens=64)
    packed = pack(pieces, 64)
    found = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in found)
    assert len(by) <= 1 + 11 * -(-total // 64) // 9
    whole = {r.sequence_id: len(r.ids) // 4 for r in sequences(packed).collect()}
    assert whole == {s: sum(n for _, n in p) for s, p in by.items()}


def test_pack_of_nothing_and_of_bad_lengths(spark):
    from lodeseek.llm.packing import pack

    pieces = spark.createDataFrame([], "doc_id long, piece int, length long")
    assert pack(pieces, 8).collect() == []
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), 8)


def test_a_sweep_matches_the_longest_pieces_with_places_that_hold_them():
    import numpy as np

    from lodeseek.llm.packing import sweep

    rng = random.Random(5)
    for _ in range(500):
        lengths = sorted(rng.sample(range(1, 30), rng.randrange(1, 6)))
        values = sorted(rng.sample(range(1, 60), rng.randrange(1, 6)))
        left = [rng.randrange(1, 6) for _ in lengths]
        counts = [rng.randrange(1, 6) for _ in values]
        found = sweep(*(np.array(x, np.int64) for x in (lengths, left, values, counts)))
        places = [v for v, n in zip(values, counts, strict=True) for _ in range(n * max(1, v // lengths[-1]))]
        free, matched = list(places), Counter()
        for n, k in list(zip(lengths, left, strict=True))[::-1]:  # one by one, the longest first
            for _ in range(k):
                if (fit := next((p for p in free if p >= n), None)) is not None:
                    free.remove(fit)
                    matched[n] += 1
        assert found.matched.tolist() == [matched[n] for n in lengths]
        taken = [f + k for f, m in zip(found.first.tolist(), found.matched.tolist(), strict=True) for k in range(m)]
        assert len(set(taken)) == len(taken)
        for n, f, m in zip(lengths, found.first.tolist(), found.matched.tolist(), strict=True):
            assert all(places[f + k] >= n for k in range(m))


@pytest.mark.parametrize("lengths", [
    [random.Random(k).randrange(1, 65) for k in range(700)],
    [random.Random(k).randrange(12, 32) for k in range(500)],
    [25] * 400 + [random.Random(k).randrange(1, 65) for k in range(300)],
    [7] * 100, [64] * 50, [1] * 200,
])
def test_pack_needs_hardly_more_sequences_than_one_by_one(spark, lengths):
    from lodeseek.llm.packing import best_fit, pack

    pieces = spark.createDataFrame([(None if k % 7 == 0 else k // 2, 0, n, "x", k) for k, n in enumerate(lengths)],
                                   "doc_id long, piece int, length long, offset string, row0 int")
    by, seen = defaultdict(list), Counter()
    for r in pack(pieces, 64).collect():
        by[r.sequence_id].append((r.offset, r.length))
        seen[r.row0, r.length] += 1
    assert seen == Counter(enumerate(lengths))
    for places in by.values():
        ends = [0, *(offset + n for offset, n in sorted(places))]
        assert [offset for offset, _ in sorted(places)] == ends[:-1] and ends[-1] <= 64
    least = max(s - (-(end - rank) // each) for _, rank, end, s, _, each in best_fit(Counter(lengths), 64))
    assert len(by) <= least + max(1, least // 50)


def test_best_fit_is_what_one_by_one_gives():
    from lodeseek.llm.packing import best_fit

    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([5, 16, 40])
        counts = {n: rng.randrange(1, 9) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, 5))}
        gaps = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fit = min((g for g in gaps if g >= n), default=None)
                gaps.remove(fit) if fit is not None else None
                gaps.append((capacity if fit is None else fit) - n)
        used, places = {}, Counter()
        for length, rank, end, sequence, offset, each in best_fit(counts, capacity):
            for k in range(end - rank):
                used.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
                places[length] += 1
        assert places == counts
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == sorted(gaps)


def test_texts_of_a_batch_are_measured_in_slices():
    import pyarrow as pa

    from lodeseek.llm.ngram_join import _measured

    text = " ".join(f"w{k}" for k in range(150_000))  # more than 1 MB
    batch = pa.record_batch({"doc_id": pa.array(range(4), pa.int64()), "text": pa.array([text] * 4)})
    sizes = [b.num_rows - b.column("n").null_count for b in _measured(5)(iter([batch]))]
    assert len(text) > 1 << 20 and max(sizes) == 1 and sum(sizes) == 4


def test_a_superstep_broadcasts_no_classes(spark, monkeypatch):
    from lodeseek.llm import packing

    seen, staged = [], packing.staged

    def kept(df):
        seen.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple"))
        return staged(df)

    monkeypatch.setattr(packing, "staged", kept)
    lengths = [600, 400, 400, 300, 90, 90, 60, 5, 5, 1]
    pieces = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else pieces as few as these are broadcast
    try:
        rows = packing.pack(pieces, 1000).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    steps = [text for text in seen if "Window" in text]
    # Only the places of ranges, which may be many, are joined as a table.
    assert len(steps) > 3 and all(text.count("BroadcastHashJoin") <= 1 for text in steps)
    assert not any("Sort [slice" in text for text in seen)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    assert len(held) == 2 and len(rows) == len(lengths)
    for parts in held.values():
        ends = [at + n for at, n in sorted(parts)]
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1000


def test_merge_dropout(spark):
    import numpy as np
    import public_tokenizers
    import sentencepiece

    from lodeseek.llm.merge_dropout import Codec, decode, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    space = chr(0x2581)
    rows = [(d, t, "s") for d, t, _ in sample(10)] + [(1000 + k, t, "s") for k, t in enumerate([*ODD, space, space * 2 + "x "])]
    rows += [(3, sample(10)[3][1], "s"), (None, "no id", "s")]
    frame = table(spark, rows)
    encoded = encode(frame, path, dropout=0.2, seed=5)
    got = decode(encoded, path).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((d, t or "") for d, t, _ in rows)
    again = encode(frame, path, dropout=0.2, seed=5).collect()
    other = encode(frame, path, dropout=0.2, seed=6).collect()
    key = lambda rs: sorted((r.doc_id or -1, bytes(r.ids)) for r in rs)
    assert key(again) == key(got) != key(other)
    plain = encode(frame, path, dropout=0.0).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert key(got) != key(plain)
    texts = dict((d, t) for d, t, _ in rows)
    for r in plain:
        if space not in (texts[r.doc_id] or ""):
            assert np.frombuffer(r.ids, np.uint32).tolist() == model.encode(texts[r.doc_id] or "")
    assert encode(empty(spark), path).collect() == []
    codec = Codec(path, 0.3, 9, 3)
    parts = [" the", " Zürich", "日本語", " 🙂x", "aaaaaaaa", space + "a", " " * 9 + "word", "x"]
    for draw in range(3):
        assert codec.segments(parts, [draw] * len(parts)) == [codec.segment(p, draw) for p in parts]


def test_encode_is_what_each_occurrence_alone_gives():
    import numpy as np
    import public_tokenizers

    from lodeseek.llm.merge_dropout import _PART, Codec
    from lodeseek.llm.words import mix

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = Codec(path, 0.1, 1)
    texts = ["the " * 4000, " ".join(["it", "windows", "on", "a" * 60, "x"] * 300), "", "the windows"]
    keys = [5, 6, 7, 1 << 63]
    for held in (1 << 20, 10):
        model.held = held
        for _ in range(2):
            for text, key, ids in zip(texts, keys, model.encode(texts, keys), strict=True):
                parts = _PART.findall(" " + text) if text else []
                draws = mix(np.arange(len(parts), dtype=np.uint64) + np.uint64(key), 41).tolist()
                assert ids == b"".join(model.segment(p, d) for p, d in zip(parts, draws, strict=True))


def test_trees_grow_for_frequent_words_only_and_as_chains():
    import numpy as np
    import public_tokenizers

    from lodeseek.llm.merge_dropout import _PART, Codec
    from lodeseek.llm.words import mix

    model = Codec(public_tokenizers.path("piece_bpe_32k.model"), 0.3, 4)
    texts = ["understanding windows understanding", "often often often", "often " * 500 + "windows"]
    for text in texts:
        parts = _PART.findall(" " + text)
        draws = mix(np.arange(len(parts), dtype=np.uint64) + np.uint64(7), 41).tolist()
        assert model.encode([text], [7]) == [b"".join(model.segment(p, d) for p, d in zip(parts, draws, strict=True))]
    assert set(model.roots) == {" often"}
    # Every branch that was grown ends in a leaf with ids.
    nodes = [model.nodes[k:k + 3] for k in range(0, len(model.nodes), 3)]
    assert len(nodes) == len(model.leaves) > 5
    assert all((ids is not None) == (candidate < 0) for (candidate, _, _), ids in zip(nodes, model.leaves, strict=True))
    assert sorted(k for n in nodes for k in n[1:] if k >= 0) == list(range(1, len(nodes)))


def test_occurrences_of_a_word_are_not_segmented_in_a_few_ways_only(spark):
    import public_tokenizers

    from lodeseek.llm.merge_dropout import encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    frame = spark.createDataFrame([(k, "understanding") for k in range(3000)], "doc_id long, text string")
    found = Counter(bytes(r.ids) for r in encode(frame, path, dropout=0.1, seed=1).collect())
    plain = bytes(encode(frame.limit(1), path, dropout=0.0).first().ids)
    assert len(found) > 4 and 0.2 < found[plain] / 3000 < 0.95


def test_long_runs_of_white_space_are_tokens_too(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodeseek.llm.packing import pack, token_pieces

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 3_000_000 + "x", "a" + "\n" * 1_000_000, "\u3000" * 300_000 + "y", " \t" * 30_000 + "\u00a0 z", " " * 20_001, " " * 19_999 + "x y"]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    pieces = token_pieces(table(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), max_tokens=1024)
    found = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: (r.doc_id, r.start)):
        found[r.doc_id] += memoryview(r.ids).cast("I").tolist()
    for k, t in enumerate(texts):
        assert found[k] == [*own.encode(t, add_special_tokens=False).ids, 2]
    assert pack(pieces, 1024).count() == pieces.count()
