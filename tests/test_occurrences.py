"""Searching stored token rows gives what a scan of the texts gives."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import World, MASTER, DEVELOP, random_world, refs_by_id
from lodeseek.operators import occurrences
from lodeseek.operators.match import (
    All, AnyOf, Everything, Field, Fuzzy, Not, NumberRange, Phrase, Prefix, Regex, Term, TermRange, Wildcard, file_fields,
)
from lodeseek.operators.ranking import term_statistics, vocabulary_statistics, with_score
from lodeseek.operators.postings import vocabulary
from lodeseek.plans import indexing, search as plan
from lodeseek.schemas import APPENDED
from lodeseek.session import lean_writes, write_sorted
from lodeseek.settings import Limits
from lodeseek.sources.store import DocumentStore
from test_plans import explain

LIMITS = Limits(indexing_enabled=True)
FIELDS = file_fields(LIMITS)
WORDS = ["the", "of", "and", "there", "three", "hter", "ing", "thing", "x_1", "Theta", "été", "a", "ab", "ba", "nation", "anition", "ration"]

CONDITIONS = [
    Term("the"), Term("The OF"), Term("absent"), Term("--"), All(Term("the"), Term("of"), Not(Term("and"))),
    AnyOf(Term("thing"), Term("md", field="path"), Term("of", boost=2.0)), Not(Term("the")), All(Not(Term("the")), Everything()),
    Phrase("the of"), Phrase("of the of"), Phrase("the the"), Phrase("absent the"), Phrase("the of and", slop=3), Phrase("the of the", slop=2),
    Phrase("the the the", slop=4), Phrase("src/dir", field="path"), Wildcard("th*"), Wildcard("*ing"), Wildcard("t?e*"), Wildcard("*e*"),
    Wildcard("t*g"), Wildcard("the"), Wildcard("???"), Wildcard("*"), Wildcard("no-code*"), Wildcard("long*w"), Prefix("x_"),
    Regex("t.*e"), Regex("(the|of)"), TermRange("n", "th"), TermRange(None, "ab"), TermRange("the", None), Fuzzy("there"), Fuzzy("nation"),
    Fuzzy("ab", edits=1), Fuzzy("ab"), Fuzzy("ter", edits=2), Fuzzy("the", edits=0), NumberRange("charcount", 50, 400),
    All(NumberRange("charcount", 50, None), Term("the")), AnyOf(NumberRange("charcount", None, 20), Fuzzy("thing")),
    All(Term("the"), AnyOf(Phrase("of and"), Wildcard("n*n")), Not(Regex("x.*"))),
]


def documents(spark, seed=1, count=60):
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        words = rng.choices(WORDS, k=rng.choice([0, 1, 4, 12, 60]))
        text = "".join(w + rng.choice([" ", "\n", "-", " , "]) for w in words)
        if k % 9 == 0:
            text += " long" + "g" * rng.choice([55, 70, 300]) + "w"
        path = rng.choice(["src/dir/f.md", "the/of.py", "A\\b.c", "", "src/dir." + "p" * 80])
        rows.append((f"d{k}", rng.choice([None, text, text]), path if k % 7 else None, len(text)))
    return spark.createDataFrame(rows, "doc_id string, contents string, path string, charcount int")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return occurrences.write_index(str(tmp_path_factory.mktemp("tokens") / "t"), [(docs, FIELDS)])


def ids(df):
    found = [r["doc_id"] for r in df.select("doc_id").collect()]
    assert len(set(found)) == len(found)
    return set(found)


@pytest.mark.parametrize("number", range(len(CONDITIONS)))
def test_hits_equal_the_scan(docs, index, number):
    condition = CONDITIONS[number]
    rows, stored = occurrences.with_evidence(docs, index, condition, FIELDS)
    assert ids(rows.filter(condition.test(stored))) == ids(docs.filter(condition.test(FIELDS)))


@pytest.mark.parametrize("number", [1, 4, 5, 9, 12, 16, 38, 40])
def test_scores_equal_the_scan(docs, index, number):
    condition = CONDITIONS[number]
    rows, stored = occurrences.with_evidence(docs, index, condition, FIELDS)
    weighted = any(leaf.weighted(f) for leaf in condition.leaves() for f in leaf.among(FIELDS))
    scan_stats = term_statistics([(docs, FIELDS)], condition) if weighted else None
    kept_stats = vocabulary_statistics(index.vocabulary(), docs.count(), [(docs, FIELDS)], condition) if weighted else None

    def scores(df, fields, stats):
        return {r["doc_id"]: r["score"] for r in with_score(df.filter(condition.test(fields)), condition, fields, stats).select("doc_id", "score").collect()}

    assert scores(rows, stored, kept_stats) == scores(docs, FIELDS, scan_stats)


@pytest.mark.parametrize("name, value", [("MANY", 1), ("SEEDS", 0)])
def test_other_ways_beyond_the_bounds(docs, index, monkeypatch, name, value):
    monkeypatch.setattr(occurrences, name, value)
    for condition in (Wildcard("t*"), All(Term("the"), Term("of"), Wildcard("*n")), Phrase("the of and", slop=3), Fuzzy("there")):
        rows, stored = occurrences.with_evidence(docs, index, condition, FIELDS)
        assert ids(rows.filter(condition.test(stored))) == ids(docs.filter(condition.test(FIELDS)))


def test_sweep_against_every_choice_of_positions(spark):
    rng = random.Random(3)
    runs = [("a", "b"), ("a", "b", "c"), ("a", "b", "a"), ("a", "a"), ("a", "a", "a"), ("b", "a", "a", "b")]
    cases = [([rng.choice("abcdx") for _ in range(rng.choice([2, 5, 9, 14]))],) for _ in range(150)]
    df = spark.createDataFrame(cases, "toks array<string>").withColumns({
        t: F.expr(f"filter(transform(toks, (x, i) -> if(x = '{t}', i, -1)), x -> x >= 0)") for t in "abc"})
    wanted = list(itertools.product(runs, (0, 1, 3)))
    tests = [occurrences.near({t: F.col(t) for t in set(run)}, run, slop).alias(f"n{k}") for k, (run, slop) in enumerate(wanted)]
    for row in df.select("toks", *tests).collect():
        for k, (run, slop) in enumerate(wanted):
            places = [[i for i, t in enumerate(row["toks"]) if t == w] for w in run]
            shifts = ([p - k for k, p in enumerate(choice)] for choice in itertools.product(*places) if len(set(choice)) == len(run))
            assert row[f"n{k}"] == any(max(s) - min(s) <= slop for s in shifts), (row["toks"], run, slop)


def edits(a, b):
    """Distance with swaps of neighbours, as sets of reachable words would give it."""
    table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            table[i][j] = min(table[i][j], table[i - 2][j - 2] + 1)
    return table[-1][-1]


def test_words_within_two_edits_share_a_deletion():
    rng = random.Random(5)
    near = 0
    for _ in range(20_000):
        a = "".join(rng.choices("ab", k=rng.randint(1, 13)))
        b = list(a)
        for _ in range(2):
            k = rng.randrange(len(b) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                b.insert(k, rng.choice("abc"))
            elif kind == 1 and len(b) > 1:
                del b[min(k, len(b) - 1)]
            elif kind == 2 and 0 < k < len(b):
                b[k - 1], b[k] = b[k], b[k - 1]
            elif k < len(b):
                b[k] = "c"
        b = "".join(b)
        if b and edits(a, b) <= 2:
            near += 1
            assert set(occurrences.deletions_of(a)) & set(occurrences.deletions_of(b)), (a, b)
    assert near > 10_000


def test_deletion_rows_are_those_of_the_query_side(spark):
    words = spark.createDataFrame([("f", w) for w in ("", "a", "ab", "abc", "abcdefghijk", "été")], "field string, term string")
    found = {}
    for r in occurrences.deletion_rows(words).collect():
        found.setdefault(r["term"], []).append(r["left"])
    for word, left in found.items():
        assert sorted(left) == occurrences.deletions_of(word)
    assert len(found) == 6


def test_every_word_of_a_pattern_has_its_rotation(spark):
    rng = random.Random(6)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(200)}
    turns = {w: [((w + "\0") * 2)[i:i + len(w) + 1] for i in range(len(w) + 1)] for w in words}
    rows = occurrences.rotation_rows(spark.createDataFrame([("f", w) for w in words], "field string, term string")).collect()
    assert sorted((r["term"], r["rotated"]) for r in rows) == sorted((w, t) for w in words for t in turns[w])
    for _ in range(300):
        pattern = "".join(rng.choices("abc?*", k=rng.randint(1, 5)))
        full = re.compile("".join({"?": ".", "*": ".*"}.get(c, c) for c in pattern))
        start = occurrences.turned(pattern)
        for w in words:
            if full.fullmatch(w):
                assert any(t.startswith(start) for t in turns[w]), (pattern, w)


def test_empty_tables(spark, tmp_path):
    none = documents(spark).limit(0)
    index = occurrences.write_index(str(tmp_path / "t"), [(none, FIELDS)])
    for condition in (Term("the"), Wildcard("t*"), Fuzzy("there"), Not(Term("the"))):
        rows, stored = occurrences.with_evidence(none, index, condition, FIELDS)
        assert rows.filter(condition.test(stored)).count() == 0


# In a store


def words_of(index):
    return {(r["field"], r["term"]): r["df"] for r in index.vocabulary().collect()}


def check_store(spark, store):
    """What is appended equals what a scan of the documents gives."""
    corpus, scanned = plan.stored_corpus(store, tokens=True), plan.stored_corpus(store)
    plain = {}
    for docs, fields in ((scanned.files, file_fields(LIMITS)), (scanned.commits, plan.commit_fields(LIMITS))):
        plain |= {(r["field"], r["term"]): r["df"] for r in vocabulary(docs, fields).collect()}
    assert words_of(corpus.tokens) == plain
    for query in (Not(Term("gamma")), AnyOf(Wildcard("c*"), Fuzzy("bta"), Term("py"), Phrase("alpha beta"))):
        request = plan.Search(query=query)
        rows = [sorted(map(tuple, plan.search(c, request).select("doc_id", "score").collect())) for c in (corpus, scanned)]
        assert rows[0] == rows[1]


@pytest.mark.parametrize("seed", [2])
def test_tokens_follow_updates(spark, tmp_path, seed):
    store, rng = DocumentStore(spark, str(tmp_path / "store")), random.Random(seed)
    world = random_world(rng)
    first = {k: (world.trees[k], world.histories[k]) for k in world.trees}
    indexing.full_build(store, world.sources(spark), LIMITS, tokens=True)
    check_store(spark, store)
    for key in list(first)[:4]:
        other = random_world(rng)
        world.trees[key], world.histories[key] = other.trees[key], other.histories[key]
    indexing.update_all(store, world.sources(spark), LIMITS)
    assert refs_by_id(store.read("files")) == world.files()
    check_store(spark, store)
    # What was removed comes back and counts once.
    for key, (tree, history) in first.items():
        world.trees[key], world.histories[key] = tree, history
    indexing.update_all(store, world.sources(spark), LIMITS)
    check_store(spark, store)
    indexing.reindex_repository(store, world.sources(spark), "proj", "two", LIMITS)
    check_store(spark, store)
    store.expire(store.latest())
    check_store(spark, store)


def test_a_repository_that_goes_takes_its_counts_along(spark, tmp_path):
    store, world = DocumentStore(spark, str(tmp_path / "store")), World()
    world.set("proj", "one", MASTER, {"a.py": b"alpha"}, {"c1"})
    world.set("proj", "two", MASTER, {"b.py": b"alpha beta"}, {"c1", "c2"})
    world.set("proj", "two", DEVELOP, {"b.py": b"alpha beta"}, {"c3"})
    indexing.full_build(store, world.sources(spark), LIMITS, tokens=True)
    world.drop("proj", "two", MASTER)
    world.drop("proj", "two", DEVELOP)
    indexing.update_all(store, world.sources(spark), LIMITS)
    words = words_of(plan.stored_corpus(store, tokens=True).tokens)
    assert words["contents", "alpha"] == 1 and ("contents", "beta") not in words
    check_store(spark, store)


def test_a_version_without_tokens_is_refused(spark, tmp_path):
    store, world = DocumentStore(spark, str(tmp_path / "store")), random_world(random.Random(1))
    indexing.full_build(store, world.sources(spark), LIMITS)
    with pytest.raises(ValueError, match="no token rows"):
        plan.stored_corpus(store, tokens=True)
    indexing.full_build(store, world.sources(spark), LIMITS, tokens=True)
    assert plan.stored_corpus(store, tokens=True).tokens is not None
    indexing.full_build(store, world.sources(spark), LIMITS)  # built anew without: the old rows are not taken over
    assert not store.has_tokens()


def test_a_page_from_token_rows_reads_no_text(spark, tmp_path):
    store, world = DocumentStore(spark, str(tmp_path / "store")), random_world(random.Random(1))
    indexing.full_build(store, world.sources(spark), LIMITS, tokens=True)
    corpus = plan.stored_corpus(store, tokens=True)
    text = explain(plan.search_page(corpus, plan.Search(query=All(Term("alpha"), Phrase("alpha beta"), Wildcard("b*")), projects="proj")))
    for schema in re.findall("ReadSchema: (.*)", text):
        assert not set(re.findall(r"(\w+):", schema)) & {"contents", "body", "subject"}
    assert re.search(r"PushedFilters: \[.*EqualTo\(term,alpha\)", text)
    assert "TakeOrderedAndProject" in text and "LeftSemi" in text


@pytest.mark.parametrize("leaf, pushed", [
    (Wildcard("*ta"), "StringStartsWith(rotated,ta"), (Wildcard("b*a"), "StringStartsWith(rotated,a"),
    (TermRange("b", "c"), "GreaterThanOrEqual(term,b)"), (Fuzzy("beta"), "In(left"),
])
def test_patterns_are_ranges_of_rows(spark, index, leaf, pushed):
    text = explain(occurrences.expanded(index, leaf, Field("contents", "code")))
    assert pushed in text


def test_hashes_are_found_without_rows_for_their_parts(spark, tmp_path):
    rows = [(f"c{k}", f"{k * 7919:08x}ab", "fix the build", f"beta {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, hash string, subject string, body string")
    fields = plan.commit_fields(LIMITS)
    index = occurrences.write_index(str(tmp_path / "t"), [(docs, fields)])
    for table in (index.rotations, index.deletions):
        assert {r["field"] for r in table.select("field").distinct().collect()} == {"subject", "body"}
    one = rows[11][1]
    for leaf in (Wildcard(one[:7] + "*"), Wildcard("*" + one[5:]), Wildcard("0*f?ab"), Wildcard("*"), Fuzzy(one), Fuzzy(one[1:]),
                 Fuzzy(one, edits=0), Regex("0+1.*b"), TermRange(one, None), Wildcard("b*a"), Fuzzy("bulid")):
        rest, stored = occurrences.with_evidence(docs, index, leaf, fields)
        wanted = ids(docs.filter(leaf.test(fields)))
        assert wanted and ids(rest.filter(leaf.test(stored))) == wanted, leaf
    assert "StringStartsWith(term,000" in explain(occurrences.expanded(index, Wildcard("000*"), fields[1]))


def test_stored_token_rows_hold_neither_document_ids_nor_words_twice(spark, index):
    assert "doc_id" not in index.occurrences.columns and "term" not in index.rotations.columns
    assert {len(r["doc"]) for r in index.occurrences.select("doc").distinct().collect()} == {20}


def test_a_word_with_the_end_mark_is_its_own_rotation(spark):
    words = spark.createDataFrame([("path", "a\0b"), ("path", "ab")], "field string, term string")
    rows = sorted((r["term"], r["rotated"], r["long"]) for r in occurrences.rotation_rows(words).collect())
    assert rows == [("a\0b", "a\0b", True), ("ab", "\0ab", False), ("ab", "ab\0", False), ("ab", "b\0a", False)]


def test_token_rows_are_shuffled_by_document_and_first_character_and_sorted_once(spark, docs):
    with lean_writes(spark):
        rows = occurrences.token_rows(docs.localCheckpoint(), FIELDS)
        text = explain(rows)
    assert text.count("rangepartitioning(field") == 1 and "ObjectHashAggregate" not in text
    assert len(re.findall(r"\bSort\b \(", text.split("== Initial Plan ==")[0])) == 1
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == "true"
    for part in rows.rdd.glom().collect():
        keys = [(r["field"], r["term"].encode(), r["doc"]) for r in part]
        assert keys == sorted(keys, key=lambda k: (k[0], k[1], k[2] is not None, bytes(k[2] or b"")))


def test_a_document_given_twice_has_the_positions_of_both_texts(spark):
    twice = spark.createDataFrame([("d", "a b a", "x"), ("d", "b ba a", "x"), ("e", None, None), (None, "a", "y")],
                                  "doc_id string, contents string, path string")
    rows = occurrences.token_rows(twice, FIELDS).collect()
    found = {(r["field"], r["term"], r["doc"] and bytes(r["doc"]).hex()): (r["positions"], r["length"]) for r in rows}
    d = "3c363836cf4e16666669a25da280a1865c2d2874"
    assert found == {
        ("contents", "a", d): ([0, 2], 3), ("contents", "b", d): ([0, 1], 3), ("contents", "ba", d): ([1], 3), ("path", "x", d): ([0], 1),
        ("contents", "a", None): ([0], 1), ("path", "y", None): ([0], 1),
    } and len(rows) == len(found)


def test_words_become_deletions_behind_the_shuffle(spark):
    words = spark.createDataFrame([("f", "reading")], "field string, term string")
    text = explain(occurrences.deletion_rows(words))
    assert "rangepartitioning(field" in text and "lead" in text
    assert len(occurrences.deletion_rows(words).collect()) == len(occurrences.deletions_of("reading")) <= 22


def test_texts_are_shuffled_and_a_part_holds_whole_documents(spark, docs):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one part
    try:
        rows = occurrences.token_rows(docs, FIELDS)
        parts = [{(r["field"], bytes(r["doc"])) for r in part} for part in rows.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(map(bool, parts)) > 2
    assert sum(map(len, parts)) == len(set().union(*parts)), "words of a document's field are in several parts"
    plan_text = explain(rows)
    assert plan_text.index("Exchange") < plan_text.index("Scan"), plan_text
    behind = plan_text[:plan_text.index("Exchange")]
    assert "Generate" in behind and plan_text.count("Generate (") == behind.count("Generate ("), "words are made before the shuffle"


def test_rotations_are_not_shuffled(spark):
    words = spark.createDataFrame([("f", "reading"), ("f", "eat")], "field string, term string")
    rows = occurrences.rotation_rows(words)
    assert "Exchange" not in explain(rows)
    turned = [r["rotated"].encode() for part in rows.rdd.glom().collect() for r in part]
    assert len(turned) == 8 + 4


def test_parts_are_written_one_after_the_other_without_their_shuffles(spark, tmp_path):
    def part(word):
        return spark.createDataFrame([("d" + word, word + " b")], "doc_id string, contents string").withColumn("path", F.lit(None).cast("string"))

    written = []

    def put(name, *dfs):
        written.append((name, len(dfs)))
        return write_sorted(str(tmp_path / name), APPENDED[name], *dfs)

    occurrences.append_rows(put, [(part("a"), FIELDS), (part("c"), FIELDS)])
    assert written == [("occurrences", 2), ("words", 1), ("rotations", 1), ("deletions", 1)]
    found = spark.read.parquet(str(tmp_path / "words")).collect()
    assert {(r["term"], r["df"]) for r in found} == {("a", 1), ("b", 2), ("c", 1)}
    with pytest.raises(Exception, match="already exists"):
        write_sorted(str(tmp_path / "words"), APPENDED["words"], spark.read.parquet(str(tmp_path / "words")))


def test_words_that_begin_alike_share_their_deletions(spark, tmp_path):
    def built(count):
        docs = spark.createDataFrame([(f"d{k}", f"number{k} there{k % 7}") for k in range(count)], "doc_id string, contents string")
        fields = [Field("contents", "code")]
        return docs, fields, occurrences.write_index(str(tmp_path / f"t{count}"), [(docs, fields)])

    docs, fields, index = built(40)
    assert index.deletions.count() == built(10)[2].deletions.count() == len(set(occurrences.deletions_of("number"))) + 7 * len(occurrences.deletions_of("there0"))
    for leaf in (Fuzzy("number7"), Fuzzy("nubmer1", edits=2), Fuzzy("umber39", edits=1), Fuzzy("three3"), Fuzzy("numb", edits=2)):
        rows, stored = occurrences.with_evidence(docs, index, leaf, fields)
        assert ids(rows.filter(leaf.test(stored))) == ids(docs.filter(leaf.test(fields))), leaf


def test_a_documents_short_fields_are_one_row_of_the_shuffle(spark):
    rows = [(f"c{k}", f"{k:08x}", "fix", f"beta {k}") for k in range(30)] + [("c0", "00000000", "mend", None), ("c31", "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, hash string, subject string, body string")
    found = occurrences.token_rows(docs, plan.commit_fields(LIMITS))
    text = explain(found)
    assert "Union" not in text and text.count("rangepartitioning(doc") == 1 and len(re.findall(r"Exchange \(", text.split("== Initial Plan ==")[0])) == 1
    terms = {(r["field"], r["term"]) for r in found.filter(occurrences.key_of(F.lit("c0")) == F.col("doc")).collect()}
    assert terms == {("hash", "00000000"), ("subject", "fix"), ("subject", "mend"), ("body", "beta"), ("body", "0")}


def test_words_are_shuffled_once(spark):
    docs = spark.createDataFrame([("d", "b a c", "x")], "doc_id string, contents string, path string")
    plans = {}

    def put(name, *dfs):
        plans[name] = explain(dfs[0])
        return dfs[0].localCheckpoint()

    occurrences.append_rows(put, [(docs, FIELDS)])
    assert "rangepartitioning" not in plans["words"].split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange \(", plans["words"].split("== Initial Plan ==")[0])) == 1
