"""Edge rows of single operators."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodeseek import schemas
from lodeseek.functions import keys
from lodeseek.functions import text as tx
from lodeseek.operators import deltas, filters, ranking, statistics
from lodeseek.plans.indexing import checkpoint_lag
from lodeseek.settings import Limits, split_list
from lodeseek.sources import catalog, snapshots


def values(spark, items, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn("x")).collect()]


def test_extension(spark):
    paths = ["a/b.JAVA", "a.b/c", "x.tar.gz", ".gitignore", "Makefile", "a.", "a.b\\c"]
    assert values(spark, paths, tx.extension) == ["java", "", "gz", "gitignore", "", "", ""]


def test_charcount(spark):
    assert values(spark, ["a😀", "", "é", None], tx.charcount) == [3, 0, 1, 0]


def line_starts(s):
    """Plain restatement: a character starts a line at the start, after LF, or after a CR it does not pair with."""
    return sum(1 for i, c in enumerate(s) if i == 0 or s[i - 1] == "\n" or (s[i - 1] == "\r" and c != "\n"))


def test_linecount(spark):
    cases = ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "a\rb", "\n", "\n\n", "a\n\nb", "\r\n", "\n\r", "a\r"]
    assert values(spark, cases, tx.linecount) == [0, 1, 1, 2, 2, 2, 1, 2, 3, 1, 2, 1]
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab\r\n") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    assert values(spark, texts, tx.linecount) == [line_starts(s) for s in texts]


def test_lines(spark):
    def plain(s):
        parts = re.split("\r?\n|\r", s)
        if s:
            while parts and parts[-1] == "":
                parts.pop()
        return parts

    rng = random.Random(1)
    texts = ["", "\n\n", "a\n \n", "\n\na", "\r"] + [
        "".join(rng.choice("ab \r\n") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    assert values(spark, texts, tx.lines) == [plain(s) for s in texts]


def test_binary_and_decoding(spark):
    data = [bytes.fromhex(h) for h in ("4100FF", "41090AE9", "1B", "7F", "0B0C", "", "C3A9")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)], "i int, x binary").orderBy("i")
    rows = df.select(tx.is_text("x"), tx.decode_text("x")).collect()
    assert [r[0] for r in rows] == [False, True, False, False, True, True, True]
    assert [r[1] for r in rows] == [None, "A\t\n�", None, None, "\x0b\x0c", "", "é"]


def test_tokens(spark):
    assert values(spark, ["Foo.bar_baz éanMENT 42", ""], lambda c: tx.tokens(c, "code")) == [
        ["foo", "bar_baz", "anment", "42"], []]
    assert values(spark, ["A/b\\C.d..e"], lambda c: tx.tokens(c, "path")) == [["a", "b", "c", "d", "e"]]
    assert values(spark, ["Élan, don't_x 5"], lambda c: tx.tokens(c, "message")) == [["élan", "don", "t_x", "5"]]
    assert values(spark, ["Refs/Heads//X"], lambda c: tx.tokens(c, "ref")) == [["refs", "heads", "x"]]
    assert values(spark, ["A b", ""], lambda c: tx.tokens(c, "exact")) == [["A b"], []]


def test_size_limit(spark):
    blobs = spark.createDataFrame([("a", 10), ("b", 11), ("c", None)], "blob string, size int")
    assert [r["blob"] for r in snapshots.within_size(blobs, 10).collect()] == ["a"]


def test_commit_records(spark):
    h = "a" * 40
    sep = "\u0002"
    records = [
        sep.join([h, "1704067200", "Ann", "a@x", "five"]),
        "\n" + sep.join(["b" * 40, "1704067200", "Ann", "a@x", "six", f"body{sep}more\n"]),
        sep.join(["c" * 39, "1704067200", "Ann", "a@x", "short hash"]),
        sep.join(["d" * 40, "soon", "Ann", "a@x", "bad time"]),
        sep.join(["e" * 40, "1704067200", "Ann", "a@x"]),
        "",
    ]
    log = spark.createDataFrame([("p", "r", x) for x in records], schemas.COMMIT_LOG)
    rows = {r["subject"]: r for r in snapshots.shape_commits(log).collect()}
    assert set(rows) == {"five", "six"}
    assert rows["five"]["body"] == "" and rows["six"]["body"] == f"body{sep}more\n"
    assert rows["six"]["hash"] == "b" * 40


DOC = "doc_id string, doc_type string, project string, repository string, refs array<string>, extension string, " \
      "authorname string, authoremail string, commitdate timestamp"


@pytest.fixture(scope="module")
def docs(spark):
    day = lambda *a: dt.datetime(*a)
    f = lambda i, ext: (i, "file", "P", "r", ["refs/heads/feature/a", "refs/heads/b"], ext, None, None, None)
    c = lambda i, when: (i, "commit", "P", "r", ["refs/heads/x"], None, "Ann Lee", "al@x.org", when)
    return spark.createDataFrame([
        f("f1", "java"), f("f2", "py"), c("c0", day(2024, 1, 4, 23, 59, 59, 999000)), c("c1", day(2024, 1, 5)),
        c("c2", day(2024, 1, 5, 23, 59, 59, 999000)), c("c3", day(2024, 1, 6)), c("c4", None),
    ], DOC).cache()


def kept(df, *conditions):
    return sorted(r["doc_id"] for r in filters.keep(df, *conditions).collect())


FILES, COMMITS = ["f1", "f2"], ["c0", "c1", "c2", "c3", "c4"]


def test_ref_filter(docs):
    assert kept(docs, filters.ref_filter("feature/b")) == FILES
    assert kept(docs, filters.ref_filter("Feature")) == FILES
    assert kept(docs, filters.ref_filter("feat")) == []
    assert filters.ref_filter("/ /, ,") is None
    assert kept(docs, filters.ref_filter("/ /,x")) == COMMITS


def test_extension_and_author_filters(docs):
    assert kept(docs, filters.extension_filter("py")) == sorted(COMMITS + ["f2"])
    assert kept(docs, filters.extension_filter("Java")) == sorted(COMMITS + ["f1"])
    for text, hit in (("lee ann", True), ("x org", True), ("ann org", False)):
        assert kept(docs, filters.author_filter(text)) == sorted((COMMITS if hit else []) + FILES)
    assert filters.author_filter(" -, ") is None and filters.extension_filter("") is None


def test_date_filter(docs):
    assert kept(docs, filters.date_filter("2024-01-05", "2024-01-05")) == sorted(["c1", "c2"] + FILES)
    assert kept(docs, filters.date_filter("2024-01-05", "")) == sorted(["c1", "c2", "c3"] + FILES)
    assert filters.date_filter("2024-02-30", "") is None
    assert kept(docs, filters.date_filter("2024-02-30", "2024-01-04")) == sorted(["c0"] + FILES)


def test_acl(spark, docs):
    grants = spark.createDataFrame([("u", "P", "r"), ("v", "P", "other")], schemas.GRANTS)
    assert filters.readable(docs, grants, "u").count() == 7
    assert filters.readable(docs, grants, "v").count() == 0
    assert filters.readable(docs, grants, "w").count() == 0
    assert filters.readable(docs, grants, None).count() == 7


def test_valid_hits(spark, docs):
    repos = spark.createDataFrame([("P", "r", "", "", "", "")], schemas.REPOSITORIES)
    no_refs = docs.withColumn("refs", F.when(F.col("doc_id") == "f1", F.array().cast("array<string>")).otherwise(F.col("refs")))
    assert filters.valid_hits(no_refs, repos).count() == 6
    assert filters.valid_hits(docs.withColumn("project", F.lit("p")), repos).count() == 0


def test_refs_to_index(spark):
    repos = spark.createDataFrame([
        ("p", "a", "", "", "refs/heads/main", "HEAD|(refs/heads/(master|develop))"),
        ("p", "b", "", "", "refs/heads/main", "refs/heads/x.*"),
        ("p", "c", "", "", "refs/heads/main", "refs/(heads"),
    ], schemas.REPOSITORIES)
    refs = ["refs/heads/master", "refs/heads/master2", "refs/heads/main", "refs/heads/x", "refs/heads/xy"]
    branches = spark.createDataFrame([("p", r, ref, "t") for r in "abc" for ref in refs], schemas.BRANCHES)
    got = sorted((r["repository"], r["ref"]) for r in catalog.select_refs(branches, repos).collect())
    assert got == [("a", "refs/heads/main"), ("a", "refs/heads/master"), ("b", "refs/heads/x"), ("b", "refs/heads/xy")]


def test_catalogs(spark):
    repos = spark.createDataFrame([("p", "r", "B", "", "", ""), ("p", "r", "A", "", "", ""), ("p", "s", "C", "", "", "")],
                                  schemas.REPOSITORIES)
    rows = catalog.repository_catalog(repos).collect()
    assert sorted((r["repository"], r["projectname"]) for r in rows) == [("r", "A"), ("s", "C")]
    branches = spark.createDataFrame([("p", "r", "x", "a" * 40), ("p", "r", "y", "short"), ("p", "r", "z", None)],
                                     schemas.BRANCHES)
    assert [r["ref"] for r in catalog.resolved_tips(branches).collect()] == ["x"]


def test_checkpoint_lag(spark):
    branches = spark.createDataFrame([("p", "r", x, x * 40) for x in "abc"], schemas.BRANCHES)
    marks = spark.createDataFrame([("p", "r", "a", "a" * 40), ("p", "r", "b", "x" * 40)], schemas.CHECKPOINTS)
    got = {r["ref"]: r["last"] for r in checkpoint_lag(branches, marks).collect()}
    assert got == {"b": "x" * 40, "c": keys.EMPTY_TREE}


def test_add_and_remove_ref(spark):
    docs = spark.createDataFrame([("1", ["a"]), ("2", ["a", "b"])], "doc_id string, refs array<string>")
    rows = lambda df: {r["doc_id"]: r["refs"] for r in df.collect()}
    every = F.lit(True)
    assert rows(deltas.add_ref(docs, "a", every)) == {"1": ["a"], "2": ["a", "b"]}
    assert rows(deltas.remove_ref(docs, "c")) == {"1": ["a"], "2": ["a", "b"]}
    assert rows(deltas.remove_ref(docs, "a")) == {"2": ["b"]}
    assert rows(deltas.remove_ref(deltas.add_ref(docs, "c", every), "c")) == {"1": ["a"], "2": ["a", "b"]}


def test_tree_delta(spark):
    tree = lambda *rows: spark.createDataFrame([("p", "r", "m", *x) for x in rows], schemas.TREE)
    delta = deltas.tree_delta(tree(("same", "1"), ("old", "2"), ("edit", "3")), tree(("same", "1"), ("new", "2"), ("edit", "4")))
    assert sorted((r["path"], r["status"]) for r in delta.collect()) == [("edit", "M"), ("new", "A"), ("old", "D")]
    changes = {r["doc_id"]: (r["add_refs"], r["drop_refs"]) for r in deltas.file_changes(delta).collect()}
    assert changes == {
        "p^r^2^:/old": ([], ["m"]), "p^r^2^:/new": (["m"], []), "p^r^3^:/edit": ([], ["m"]), "p^r^4^:/edit": (["m"], [])}


def test_ranking_other_row(spark):
    def ranked(n):
        df = spark.createDataFrame([(f"k{i:02d}",) for i in range(n) for _ in range(2)], "x string")
        return statistics.ranking(statistics.counts(df, "x")).collect()

    assert len(ranked(25)) == 25 and not any(r["other"] for r in ranked(25))
    rows = ranked(30)
    assert len(rows) == 26
    assert [(r["key"], r["count"]) for r in rows if r["other"]] == [("Other", 10)]
    assert abs(sum(r["proportion"] for r in rows) - 1) < 1e-9
    empty = spark.createDataFrame([], "x string")
    assert statistics.ranking(statistics.counts(empty, "x")).collect() == []


def test_statistics_of_nothing_and_approximations(spark):
    df = spark.createDataFrame([(i % 100, f"u{i % 50}") for i in range(1000)], "charcount int, authoremail string")
    exact = {r["percentile"]: r["value"] for r in statistics.percentiles(df, "charcount").collect()}
    near = {r["percentile"]: r["value"] for r in statistics.percentiles(df, "charcount", approximate=True).collect()}
    assert exact[50.0] == 49.5 and all(abs(exact[p] - near[p]) <= 1 for p in exact)
    assert statistics.distinct_values(df, "authoremail").first()[0] == 50
    assert abs(statistics.distinct_values(df, "authoremail", approximate=True).first()[0] - 50) <= 1
    nothing = statistics.extended_stats(df.limit(0), "charcount").first()
    assert nothing["count"] == 0 and nothing["min"] is None and nothing["avg"] is None


def test_pages(spark):
    assert [ranking.page_number(p) for p in ("2", 3, "-1", "x", None, 2**40)] == [2, 3, 0, 0, 0, 0]
    hits = spark.createDataFrame([(f"d{i:03d}", 1.0) for i in range(101)], "doc_id string, score double")
    page = ranking.page_of(hits, 1, 50).collect()
    assert [page[0]["doc_id"], page[-1]["doc_id"], len(page)] == ["d050", "d099", 50]
    assert ranking.page_bounds(hits, 2, 50).first() == Row(total_hits=101, pages=3, result_from=101, result_to=101)
    assert ranking.page_bounds(hits.limit(0), 0, 50).first() == Row(total_hits=0, pages=0, result_from=0, result_to=0)


def test_limits():
    assert Limits(page_size=5).page_size == 5
    for bad in ({"page_size": 4}, {"page_size": 1001}, {"max_file_size": 1023}, {"commit_hash_boost": 0.0},
                {"page_size": "50"}, {"max_match_lines": 1.5}, {"search_timeout_ms": True}):
        with pytest.raises(ValueError):
            Limits(**bad)
    assert split_list(" a, ,b,") == ["a", "b"] and split_list(None) == []


def test_dates_print(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30, 7, 5, 59),), (None,)], "commitdate timestamp")
    assert [r[0] for r in df.select(keys.printed_date()).collect()] == ["2024-12-30 07:05", ""]


def test_primary_and_display_refs(spark):
    df = spark.createDataFrame([(["refs/heads/z", "refs/heads/master", "refs/heads/z"],), (["b", "a"],)], "refs array<string>")
    rows = df.select(keys.primary_ref(), keys.display_refs()).collect()
    assert [tuple(r) for r in rows] == [
        ("refs/heads/master", ["refs/heads/master", "refs/heads/z"]), ("a", ["a", "b"])]


def test_needed_blobs_and_repeated_log_records(spark, tmp_path):
    blobs = spark.createDataFrame([(c * 40, n, bytearray(b"x")) for c, n in (("a", 1), ("b", 1), ("c", 99))], schemas.BLOBS)
    folder = str(tmp_path / "blobs")
    blobs.withColumn("prefix", F.substring("blob", 1, snapshots.PREFIX_DIGITS)).write.partitionBy("prefix").parquet(folder)
    places = spark.createDataFrame([("a" * 40,), ("a" * 40,), ("c" * 40,)], "blob string")
    for table in (blobs, spark.read.parquet(folder)):
        assert [r["blob"] for r in snapshots.needed_blobs(table, places, 10).collect()] == ["a" * 40]
    plan = snapshots.needed_blobs(spark.read.parquet(folder), spark.read.parquet(folder).filter("size = 1"), 10)
    assert plan.count() == 2

    record = "\u0002".join(["f" * 40, "1704067200", "Ann", "a@x", "s"])
    log = spark.createDataFrame([("p", "r", record), ("p", "r", record)], schemas.COMMIT_LOG)
    at = spark.createDataFrame([("p", "r", "f" * 40, ["x"])], "project string, repository string, hash string, refs array<string>")
    assert [r["doc_id"] for r in snapshots.build_commits(at, log).collect()] == ["p^r^" + "f" * 40]


def test_merged_cardinality_on_both_sides_of_the_threshold(spark):
    def merged(rows):
        frame = spark.createDataFrame(rows, "project string, repository string, value string, sketch int")
        parts = statistics.cardinality_parts(frame, "value", threshold=20)
        assert all(r["values"] is None or len(r["values"]) <= 20 for r in parts.collect())
        return statistics.merged_cardinality(parts, threshold=20).first()["cardinality"]

    def rows(project, repository, values):
        return [(project, repository, v if v is None else str(v), 1) for v in values]

    assert merged(rows("p", "r", [])) == 0 == merged(rows("p", "r", [None, None]))
    assert merged(rows("p", "r", range(15)) * 9 + rows("p", None, range(5, 20)) + rows(None, None, [None, 3])) == 20
    assert abs(merged(rows("p", "r", range(15)) + rows("p", "s", range(10, 25))) - 25) <= 1  # each few, together more
    assert abs(merged(rows("p", "r", range(3000)) * 2 + rows("q", "r", range(2990, 3010))) - 3010) <= 0.05 * 3010
