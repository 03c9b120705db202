"""Shapes of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodeseek.checks.queries import LIMITS, QUERIES
from lodeseek.plans import search as plan
from lodeseek.sources.store import DocumentStore

FOLDER = "/root/testdata/sf0.001"


def explain(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    text = explain(QUERIES[name](spark, FOLDER))
    assert not re.search("Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize("name", [
    "match_all_terms", "match_boolean", "match_wildcard", "match_fuzzy", "match_phrase", "match_sloppy", "snippet",
    "snippet_text", "preview_lines", "match_lines", "highlight_terms", "filter_ref_tokens", "filter_author",
])
def test_row_local_work_has_no_shuffle(spark, name):
    assert "Exchange" not in explain(entry.queries()[name](spark, FOLDER))


def test_facets_reach_the_scan(spark):
    text = explain(entry.queries()["filter_project"](spark, FOLDER))
    assert "In(lang, [EN,en,es])" in text
    text = explain(entry.queries()["filter_date"](spark, FOLDER))
    assert "ReadSchema: struct<event_id:bigint,ts:" in text


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    from lodeseek.checks.queries import _sources
    from lodeseek.plans.indexing import full_build

    store = DocumentStore(spark, str(tmp_path_factory.mktemp("store")))
    full_build(store, _sources(spark, FOLDER), LIMITS)
    return store


def test_page_of_stored_table_reads_contents_once_for_matching(spark, store):
    """Filters on stored columns are pushed; a file-name search reads no contents at all."""
    corpus = plan.stored_corpus(store)
    request = plan.Search(query="java", filenames=True, projects="en", extensions="java")
    text = explain(plan.search_page(corpus, request))
    assert "contents" not in text
    assert "EqualTo(project,en)" in text or "In(project" in text
    assert "EqualTo(extension,java)" in text or "In(extension" in text
    assert "TakeOrderedAndProject" in text


def test_statistics_of_stored_table_read_no_text(spark, store):
    corpus = plan.stored_corpus(store)
    text = explain(plan.search_statistics(corpus, plan.Search(query="")))
    for schema in re.findall("ReadSchema: (.*)", text):
        assert not set(re.findall(r"(\w+):", schema)) & {"contents", "body", "subject", "path"}


def test_one_repository_reads_its_buckets(spark, store):
    text = explain(store.repository("files", "en", "src3"))
    partition = re.search(r"PartitionFilters: \[(.*)\]", text).group(1)
    assert "bucket" in partition
    assert store.repository("files", "en", "src3").count() == store.read("files").filter(
        (F.col("project") == "en") & (F.col("repository") == "src3")).count()


def test_readable_buckets_are_pruned_at_run_time(spark, store):
    grants = spark.createDataFrame(
        [("u", "en", "src3")], "user_id string, project string, repository string")
    grants.write.mode("overwrite").parquet(store.root + "/grants")
    corpus = plan.stored_corpus(store, grants=spark.read.parquet(store.root + "/grants"))
    found = plan.search(corpus, plan.Search(query="", user="u", code=True), scored=False)
    assert "dynamicpruning" in explain(found)
    assert found.count() == store.repository("files", "en", "src3").count() > 0


def test_named_repositories_prune_buckets(spark, store):
    corpus = plan.stored_corpus(store)
    request = plan.Search(query="", projects="en", repositories="src3,src4", code=True)
    found = plan.search(corpus, request, scored=False)
    assert re.search(r"PartitionFilters: \[.*bucket", explain(found))
    assert found.count() == store.read("files").filter("project = 'en' and repository in ('src3', 'src4')").count()


def test_snippets_of_stored_tables(spark, store):
    corpus = plan.stored_corpus(store)
    request = plan.Search(query="the", code=True)
    rows = plan.search_snippets(corpus, request).collect()
    assert len(rows) == min(50, store.read("files").filter(F.col("contents").rlike(r"(?i)\bthe\b")).count())
    assert all(r["source_lines"] and not r["is_preview"] for r in rows)



def test_stored_vocabulary_gives_the_same_scores(spark, store):
    from lodeseek.plans.indexing import index_vocabulary

    request = plan.Search(query="the en", code=True)
    scores = lambda c: {r["doc_id"]: r["score"] for r in plan.search(c, request).select("doc_id", "score").collect()}
    assert store.vocabulary(1) is None
    scanned = scores(plan.stored_corpus(store))
    index_vocabulary(store)
    corpus = plan.stored_corpus(store)
    assert corpus.vocabulary is not None and scores(corpus) == scanned and scanned
    assert "field#" in explain(plan.search(corpus, request)).split("Subqueries")[1]
