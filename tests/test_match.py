"""Text conditions and snippets against plain-Python restatements."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import postings, snippets
from lodeseek.operators.match import (
    All, AnyOf, Everything, Field, Fuzzy, Not, NumberRange, Phrase, Prefix, Regex, Term, TermRange, Wildcard,
    all_terms, default_edits, matched_forms, swapped,
)

CODE = Field("contents", "code")
PATH = Field("path", "path", 5.0)
WORDS = ["foo", "Bar", "baz", "FOO", "a_b", "x1"]
GAPS = [" ", ".", "\n", " - ", "é"]


def cut(s):
    return [t.lower() for t in re.split("[^A-Za-z0-9_]+", s) if t]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    out = []
    for i in range(400):
        n = rng.randint(0, 9)
        out.append((i, "".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(n)), f"lib/{rng.choice(WORDS)}.py"))
    df = spark.createDataFrame(out, "doc_id int, contents string, path string").coalesce(2).cache()
    return df, out


def near(tokens, run, slop):
    spots = [[i for i, t in enumerate(tokens) if t == w] for w in run]
    for choice in itertools.product(*spots):
        adjusted = [p - k for k, p in enumerate(choice)]
        if len(set(choice)) == len(choice) and max(adjusted) - min(adjusted) <= slop:
            return True
    return False


def runs(tokens, run):
    return sum(tokens[i:i + len(run)] == run for i in range(len(tokens)))


@pytest.mark.parametrize(("condition", "plain"), [
    (Term("FOO"), lambda t: "foo" in t),
    (Term("foo.bar"), lambda t: "foo" in t and "bar" in t),
    (Term("fo"), lambda t: "fo" in t),
    (Term("..."), lambda t: False),
    (Phrase("foo bar"), lambda t: runs(t, ["foo", "bar"]) > 0),
    (Phrase("foo foo foo"), lambda t: runs(t, ["foo"] * 3) > 0),
    (Phrase("foo bar", slop=1), lambda t: near(t, ["foo", "bar"], 1)),
    (Phrase("foo bar baz", slop=3), lambda t: near(t, ["foo", "bar", "baz"], 3)),
    (Phrase("foo foo", slop=2), lambda t: near(t, ["foo", "foo"], 2)),
    (Phrase("foo bar foo", slop=2), lambda t: near(t, ["foo", "bar", "foo"], 2)),
    (Phrase("bar foo foo foo", slop=4), lambda t: near(t, ["bar", "foo", "foo", "foo"], 4)),
    (Wildcard("?a*"), lambda t: any(re.fullmatch(".a.*", x) for x in t)),
    (Prefix("Ba"), lambda t: any(x.startswith("ba") for x in t)),
    (Wildcard("a-b*"), lambda t: False),
    (Regex("[a-z]\\d"), lambda t: any(re.fullmatch("[a-z][0-9]", x) for x in t)),
    (TermRange("bar", "Baz"), lambda t: any("bar" <= x <= "baz" for x in t)),
    (TermRange("foo", None), lambda t: any(x >= "foo" for x in t)),
    (Fuzzy("bra"), lambda t: "bar" in t),
    (All(Term("foo"), Not(Term("bar"))), lambda t: "foo" in t and "bar" not in t),
    (AnyOf(Term("foo"), All(Term("bar"), Term("x1"))), lambda t: "foo" in t or ("bar" in t and "x1" in t)),
    (Everything(), lambda t: True),
    (Not(Everything()), lambda t: False),
], ids=str)
def test_conditions(texts, condition, plain):
    df, rows = texts
    got = {r["doc_id"] for r in df.filter(condition.test([CODE])).select("doc_id").collect()}
    assert got == {i for i, s, _ in rows if plain(cut(s))}


def test_phrase_counts_overlap(spark):
    df = spark.createDataFrame([("a a b a a a",)], "contents string")
    message = Field("contents", "message")
    for field in (CODE, message):
        row = df.select(field.count_run(["a", "a"]), field.count("a"), field.length()).first()
        assert tuple(row) == (3, 5, 6)


def test_fields_and_terms(texts):
    df, rows = texts
    both = [PATH, CODE]
    got = df.filter(all_terms("foo py").test(both)).count()
    assert got == sum(("foo" in cut(s) or "foo" in p.lower().replace(".", "/").split("/")) for _, s, p in rows)
    assert df.filter(Term("py", field="contents").test(both)).count() == 0
    assert df.filter(Term("py", field="subject").test(both)).count() == 0
    assert df.filter(all_terms("  ").test(both)).count() == len(rows)
    assert df.filter(Phrase("lib/bar.py").test([PATH])).count() == sum(p == "lib/Bar.py" for _, _, p in rows)


def test_numbers(spark):
    df = spark.createDataFrame([(5,), (50,), (None,)], "n int")
    count = lambda *a: df.filter(NumberRange("n", *a).test([])).count()
    assert [count(5, 50), count("6"), count("abc"), count(None, "49.5")] == [2, 1, 0, 1]


def test_fuzzy_edits(spark):
    assert [default_edits(w) for w in ("ab", "abc", "abcde", "abcdef")] == [0, 1, 1, 2]
    assert swapped("aab") == ["aba"]
    df = spark.createDataFrame([("plntir",), ("paltnir",), ("palantri",), ("apalntir",), ("other",)], "contents string")
    got = {r[0] for r in df.filter(Fuzzy("palntir").test([CODE])).collect()}
    assert got == {"plntir", "paltnir", "palantri", "apalntir"}
    assert df.filter(Fuzzy("Other", edits=0).test([CODE])).count() == 1


def test_token_tables(texts):
    df, rows = texts
    occurrences = postings.postings(df, [CODE]).cache()
    ids = lambda d: {r["doc_id"] for r in d.collect()}
    assert ids(postings.documents_with_all(occurrences, ["foo", "bar"])) == {
        i for i, s, _ in rows if {"foo", "bar"} <= set(cut(s))}
    for run in (["foo", "bar"], ["foo", "foo"], ["foo", "bar", "foo"]):
        starts = {(r["doc_id"], r["start"]) for r in postings.phrase_starts(occurrences, run).collect()}
        assert starts == {(i, k) for i, s, _ in rows for k in range(len(cut(s))) if cut(s)[k:k + len(run)] == run}
    words = {r["term"]: r["df"] for r in postings.vocabulary(df, [CODE]).collect()}
    assert words["foo"] == sum("foo" in cut(s) for _, s, _ in rows)


def test_stored_token_table(spark, texts, tmp_path):
    df, rows = texts
    folder = str(tmp_path / "postings")
    postings.write_postings(postings.postings(df, [CODE, PATH]), folder)
    stored = spark.read.parquet(folder)
    found = postings.documents_with_all(stored, ["foo", "x1"], ["contents"])
    assert {r["doc_id"] for r in found.collect()} == {i for i, s, _ in rows if {"foo", "x1"} <= set(cut(s))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [term_bucket" in plan or "PartitionFilters: [isnotnull(term_bucket" in plan \
        or "term_bucket" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


# --- snippets

def plain_snippet(text, forms, context, preview, limit):
    """The line rules said again over Python lists: (is_preview, [(number, line)], excess)."""
    rows = re.split("\r?\n|\r", text)
    if text:
        while rows and rows[-1] == "":
            rows.pop()
    hits = [i for i, row in enumerate(rows) if any(f in row for f in forms)]
    if not hits:
        return True, [(i + 1, r) for i, r in enumerate(rows[:preview])], max(len(rows) - preview, 0)
    close = {j for i in hits for j in range(i - context, i + context + 1) if 0 <= j < len(rows)}
    gaps = {i - context - 1 for i in hits[1:]} - close
    kept = sorted(close | {g for g in gaps if g >= 0})
    shown = [(j + 1, rows[j]) if j in close else (-1, "") for j in kept[:limit]]
    return False, shown, max(len(kept) - limit, 0)


def spark_snippets(spark, texts, forms, context=1, preview=3, limit=50):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, contents string").coalesce(2)
    column = snippets.snippet("contents", F.array(*map(F.lit, forms)), context, preview, limit)
    rows = df.select("i", column.alias("s")).orderBy("i").collect()
    return [(r.s.is_preview, [tuple(x) for x in r.s.shown], r.s.excess) for r in rows]


@pytest.mark.parametrize(("at", "limit", "numbers", "preview", "excess"), [
    ([5], 50, [4, 5, 6], False, 0),
    ([5, 7], 50, [4, 5, 6, 7, 8], False, 0),
    ([3, 6], 50, [2, 3, 4, 5, 6, 7], False, 0),
    ([2, 6], 50, [1, 2, 3, -1, 5, 6, 7], False, 0),
    ([2, 9], 50, [1, 2, 3, -1, 8, 9, 10], False, 0),
    ([2, 9], 4, [1, 2, 3, -1], False, 3),
    ([1], 50, [1, 2], False, 0),
    ([12], 50, [11, 12], False, 0),
    ([], 50, [1, 2, 3], True, 9),
])
def test_snippet_rows(spark, at, limit, numbers, preview, excess):
    text = "\n".join("has foo" if i in at else f"line {i}" for i in range(1, 13))
    [(is_preview, shown, rest)] = spark_snippets(spark, [text], ["foo"], limit=limit)
    assert ([n for n, _ in shown], is_preview, rest) == (numbers, preview, excess)


def test_snippet_small_texts(spark):
    got = spark_snippets(spark, ["", "\n\n", "Foo"], ["foo"])
    assert got == [(True, [(1, "")], 0), (True, [], 0), (True, [(1, "Foo")], 0)]


@pytest.mark.parametrize("context", [0, 1, 2])
def test_snippets_random(spark, context):
    rng = random.Random(context)
    texts = [
        "".join(rng.choice(["foo", "x", "", "Foo bar", "y foo"]) + rng.choice(["\n", "\n", "\r\n", "\r"])
                for _ in range(rng.randint(0, 25)))
        for _ in range(400)
    ]
    got = spark_snippets(spark, texts, ["foo", "bar"], context, 4, 7)
    assert got == [plain_snippet(t, ["foo", "bar"], context, 4, 7) for t in texts]


def test_joined_snippet(spark):
    text = "\n".join("foo" if i in (2, 11) else f"l{i}" for i in range(1, 13))
    df = spark.createDataFrame([("d", text)], "doc_id string, contents string")
    row = snippets.with_snippets(df, F.array(F.lit("foo"))).first()
    assert row["source_lines"] == "l1\nfoo\nl3\n\nl10\nfoo\nl12\n"
    assert row["source_line_nums"] == " 1\n 2\n 3\n  \n10\n11\n12\n"
    assert (row["shown_lines"], row["excess_lines"]) == (7, 0)


def test_forms(spark):
    df = spark.createDataFrame([("Foo foo FOO bar_x Bar",)], "contents string")
    forms = lambda c, n=50: df.select(matched_forms(c, CODE, n)).first()[0]
    assert forms(Term("foo")) == ["Foo", "foo", "FOO"]
    assert forms(Term("foo"), 2) == ["Foo", "foo"]
    assert forms(All(Prefix("bar"), Not(Term("foo")))) == ["bar_x", "Bar"]
    assert forms(Everything()) == []
    assert forms(Term("foo", field="path")) == []


def test_query_text_is_never_syntax(spark):
    """Quotes, backticks, dots and pattern characters in a query are just text."""
    from lodeseek import Corpus, Search, schemas, search, search_snippets

    files = spark.createDataFrame(
        [("f1", "p", "r", ["x"], "b", "a`b/c'd.py", "py", "say `hi` (now) $1.5 \\\\ end", 20, 1)], schemas.FILES)
    commits = spark.createDataFrame([("c1", "p", "r", ["x"], "h`1", None, "A", "a@x", "it's `hi`", "")], schemas.COMMITS)
    corpus = Corpus(files, commits)
    found = lambda q: sorted(r["doc_id"] for r in search(corpus, Search(query=q)).collect())
    assert found("`hi`") == ["c1", "f1"]
    assert found("(now) $1.5") == ["f1"]
    assert found("h`1") == ["c1"]
    assert found("a`b") == ["f1"]
    assert found("[ *") == []
    assert found(Phrase("it's `hi`")) == ["c1"]
    assert found(AnyOf(Phrase("`hi` (now)", slop=1), Wildcard("h`?"))) == ["c1", "f1"]
    assert search_snippets(corpus, Search(query="`hi`", code=True)).first()["source_lines"].startswith("say `hi`")
