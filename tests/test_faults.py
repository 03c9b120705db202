"""Inputs at the edge: refused with a reason, or answered."""

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import filters, hits, postings, ranking
from lodeseek.operators.match import Fuzzy, Regex
from lodeseek.sources import catalog, snapshots


def test_conditions_are_checked_when_built(spark):
    for edits in (-1, 3):
        with pytest.raises(ValueError):
            Fuzzy("word", edits)
    with pytest.raises(ValueError):
        Regex("(")
    Regex("a+"), Fuzzy("word", 2)


def test_pages_beyond_the_last_number(spark):
    found = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.5)], "doc_id string, score double")
    with pytest.raises(ValueError):
        ranking.page_of(found, 2**26, 50)
    assert [r.doc_id for r in ranking.page_after(found, 1.0, "a", 5).collect()] == ["b", "c"]
    assert ranking.page_after(found, 0.5, "c", 5).count() == 0


def test_more_words_than_bits(spark):
    words = [f"w{k}" for k in range(70)]
    rows = [("f", w, "all", k) for k, w in enumerate(words)] + [("f", w, "most", k) for k, w in enumerate(words[1:])]
    table = spark.createDataFrame(rows + rows[:3], "field string, term string, doc_id string, pos int")
    assert [r.doc_id for r in postings.documents_with_all(table, words).collect()] == ["all"]
    assert [tuple(r) for r in postings.phrase_starts(table, words).collect()] == [("all", "f", 0)]
    twice = spark.createDataFrame([("f", "a", "d", k) for k in range(4)], table.schema)
    assert sorted(r.start for r in postings.phrase_starts(twice, ["a", "a", "a"]).collect()) == [0, 1]


def test_the_last_day(spark):
    row = spark.sql("SELECT timestamp '2024-01-02 00:00:00' AS commitdate")
    assert row.filter(filters.date_filter(None, "9999-12-31", "commit")).count() == 1
    assert row.filter(filters.date_filter(None, "2024-01-01", "commit")).count() == 0
    assert row.filter(filters.date_filter(None, "2024-01-02", "commit")).count() == 1


def test_a_date_out_of_range_drops_its_record(spark):
    sep = "\u0002"
    records = [sep.join(["a" * 40, when, "n", "m", "s", "b"]) for when in ("1", str(10**17), str(-(10**18)), "x")]
    log = spark.createDataFrame([("p", "r", r) for r in records], "project string, repository string, record string")
    assert [r.commitdate.timestamp() for r in snapshots.shape_commits(log).collect()] == [1.0]


def test_repeated_repository_rows_multiply_nothing(spark):
    repos = spark.createDataFrame(
        [("p", "r", "P", name, "refs/heads/master", "HEAD") for name in ("R", "Q")],
        "project string, repository string, projectname string, repositoryname string, default_branch string, ref_regex string")
    found = spark.createDataFrame([("d", "p", "r")], "doc_id string, project string, repository string")
    assert [r.repositoryname for r in hits.with_names(found, repos).collect()] == ["Q"]
    branches = found.select("project", "repository", F.lit("refs/heads/master").alias("ref"))
    assert catalog.select_refs(branches, repos).count() == 1


def test_a_search_that_takes_too_long(spark):
    from lodeseek.plans.search import within_timeout
    from lodeseek.settings import Limits

    limits = Limits(search_timeout_ms=1000)
    assert within_timeout(spark, limits, lambda: spark.range(3).count()) == 3
    slow = spark.range(8).select(F.expr("reflect('java.lang.Thread', 'sleep', 5000L)"))
    with pytest.raises(TimeoutError):
        within_timeout(spark, limits, lambda: slow.collect())
    with pytest.raises(ZeroDivisionError):
        within_timeout(spark, limits, lambda: 1 / 0)
