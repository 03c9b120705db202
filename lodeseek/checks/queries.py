"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.checks.oracle import MANY_WORDS
from lodeseek.functions import keys
from lodeseek.functions.keys import Buckets
from lodeseek.functions import text as tx
from lodeseek.operators import deltas, filters, hits, postings, ranking, snippets, statistics
from lodeseek.operators.match import (
    All, AnyOf, Everything, Field, Fuzzy, Not, NumberRange, Phrase, Prefix, Regex, Term, TermRange, Wildcard,
    commit_fields, file_fields, matched_forms,
)
from lodeseek.operators.occurrences import TokenIndex, with_evidence, write_index
from lodeseek.plans import indexing, search as plan
from lodeseek.session import shared_dir
from lodeseek.settings import PRECISION_THRESHOLD, Limits
from lodeseek.sources import adapters as src
from lodeseek.sources import catalog, snapshots
from lodeseek.sources.store import DocumentStore
from lodeseek.streaming import updates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LIMITS = Limits(indexing_enabled=True)
CONTENTS = Field("contents", "code")
PATH = Field("path", "path", LIMITS.file_name_boost)
FILE_FIELDS = file_fields(LIMITS)
COMMIT_FIELDS = commit_fields(LIMITS)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(column: Column | str) -> Column:
    return F.array_join(column, ",")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return src.document_files(spark, d)


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return src.event_commits(spark, d)


def _both(spark: SparkSession, d: str) -> DataFrame:
    return hits.union_types(_files(spark, d), _commits(spark, d))


def _corpus(spark: SparkSession, d: str, acl: bool = False) -> plan.Corpus:
    grants = src.grants(spark, d) if acl else None
    return plan.Corpus(_files(spark, d), _commits(spark, d), src.repositories(spark, d) if acl else None, grants)


# --- scans and sources

@query
def repo_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.repository_catalog(src.repositories(spark, d))


@query
def branch_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.branch_catalog(src.branches(spark, d))


@query
def ref_tips(spark: SparkSession, d: str) -> DataFrame:
    return catalog.resolved_tips(src.branches(spark, d)).select(keys.ref_key().alias("ref_key"), "tip")


@query
def tree_delta(spark: SparkSession, d: str) -> DataFrame:
    return deltas.tree_delta(src.tree(spark, d, src.OLD_TIP), src.tree(spark, d, src.NEW_TIP))


@query
def size_prune(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.within_size(src.blobs(spark, d), 4_096).select("blob", "size")


@query
def blob_contents(spark: SparkSession, d: str) -> DataFrame:
    blobs = snapshots.text_blobs(src.blobs(spark, d), LIMITS.max_file_size)
    return blobs.select("blob", F.sha1("contents").alias("digest"), "charcount", "linecount")


@query
def text_only(spark: SparkSession, d: str) -> DataFrame:
    """Texts, and their digests as raw bytes, which are binary nearly always."""
    docs = src.table(spark, d, "documents")
    kinds = F.array(
        F.struct(F.lit("text").alias("kind"), F.encode("text", "UTF-8").alias("content")),
        F.struct(F.lit("digest").alias("kind"), F.unhex(F.sha2("text", 256)).alias("content")),
    )
    rows = docs.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.*")
    return rows.select("doc_id", "kind", tx.is_text("content").alias("is_text"))


@query
def commits_added(spark: SparkSession, d: str) -> DataFrame:
    return deltas.commit_delta(src.reach(spark, d, src.OLD_TIP), src.reach(spark, d, src.NEW_TIP))[0]


@query
def commits_removed(spark: SparkSession, d: str) -> DataFrame:
    return deltas.commit_delta(src.reach(spark, d, src.OLD_TIP), src.reach(spark, d, src.NEW_TIP))[1]


@query
def commit_shape(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.shape_commits(src.commit_log(spark, d)).withColumn("commitdate", keys.printed_date())


@query
def checkpoint_lag(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints of the develop refs are current, those of master point elsewhere, others are missing."""
    tips = src.branches(spark, d)
    marks = tips.filter(F.col("ref").isin(src.MASTER, src.DEVELOP)).select(
        "project", "repository", "ref",
        F.when(F.col("ref") == src.MASTER, F.sha1("tip")).otherwise(F.col("tip")).alias("hash"),
    )
    return indexing.checkpoint_lag(tips, marks)


@query
def search_scan(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d).groupBy("doc_type", "project").agg(F.count(F.lit(1)).alias("n"))


# --- derived columns

@query
def extension(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).unionByName(src.page_files(spark, d))
    return files.select("path", tx.extension("path").alias("extension"))


@query
def charcount(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("doc_id", "charcount")


@query
def linecount(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).unionByName(src.page_files(spark, d)).select("doc_id", "linecount")


@query
def doc_keys(spark: SparkSession, d: str) -> DataFrame:
    both = _both(spark, d)
    return both.select("doc_type", "doc_id", keys.repo_key().alias("repo_key"))


@query
def commit_dates(spark: SparkSession, d: str) -> DataFrame:
    shaped = snapshots.shape_commits(src.commit_log(spark, d))
    return shaped.select("hash", F.unix_timestamp("commitdate").alias("epoch"))


@query
def hit_refs(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d).select("doc_id", _joined(keys.display_refs()).alias("refs"))


@query
def primary_ref(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("doc_id", keys.primary_ref().alias("primary_ref"))


@query
def commit_hits(spark: SparkSession, d: str) -> DataFrame:
    both = _commits(spark, d).unionByName(src.message_commits(spark, d))
    return hits.commit_hits(both).withColumn("refs", _joined("refs"))


@query
def file_hits(spark: SparkSession, d: str) -> DataFrame:
    shaped = hits.file_hits(_files(spark, d), LIMITS.no_highlight_extensions)
    return shaped.withColumn("refs", _joined("refs"))


@query
def no_highlight(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("doc_id", filters.no_highlight(" TXT, log,,").alias("no_highlight"))


@query
def hit_names(spark: SparkSession, d: str) -> DataFrame:
    named = hits.with_names(_both(spark, d), src.repositories(spark, d))
    return named.select("doc_id", "projectname", "repositoryname")


@query
def union_types(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d).select("doc_type", "doc_id", "path", "extension", "subject", "authoremail", "linecount")


# --- tokenizers: every term with its documents and occurrences

def _terms(df: DataFrame, tokens: Column) -> DataFrame:
    """Lower-casing after the explode stays inside generated code."""
    return df.select(F.explode(tokens).alias("t")).select(F.lower("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def tok_code(spark: SparkSession, d: str) -> DataFrame:
    return _terms(_files(spark, d), tx.surface_tokens("contents", "code"))


@query
def tok_author(spark: SparkSession, d: str) -> DataFrame:
    both = F.concat(tx.surface_tokens("authorname", "name"), tx.surface_tokens("authoremail", "email"))
    return _terms(_commits(spark, d), both)


@query
def tok_ref(spark: SparkSession, d: str) -> DataFrame:
    return _terms(_both(spark, d), tx.ref_tokens("refs"))


@query
def tok_path(spark: SparkSession, d: str) -> DataFrame:
    return _terms(_files(spark, d).unionByName(src.page_files(spark, d)), tx.surface_tokens("path", "path"))


@query
def tok_message(spark: SparkSession, d: str) -> DataFrame:
    both = F.concat(tx.surface_tokens("subject", "message"), tx.surface_tokens("body", "message"))
    return _terms(src.message_commits(spark, d).unionByName(_commits(spark, d)), both)


@query
def tok_exact(spark: SparkSession, d: str) -> DataFrame:
    return _terms(_files(spark, d), tx.tokens("extension", "exact"))


# --- filters

def _ids(df: DataFrame) -> DataFrame:
    return df.select("doc_type", "doc_id")


def _kept(spark: SparkSession, d: str, *conditions: Column | None) -> DataFrame:
    return _ids(filters.keep(_both(spark, d), *conditions))


@query
def filter_type(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, filters.type_filter(commits=True))


@query
def filter_type_default(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, filters.type_filter())


@query
def filter_project(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, filters.project_filter("en, es,,EN"))


@query
def filter_repository(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, filters.repository_filter("src1,src17"))


@query
def filter_project_repository(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, filters.one_repository("en", "src3"))


@query
def filter_ref_exact(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, filters.exact_ref(src.FEATURE_A))


@query
def filter_ref_tokens(spark: SparkSession, d: str) -> DataFrame:
    """``master feature`` needs tokens of two different refs of one document."""
    return _kept(spark, d, filters.ref_filter("Feature/B, / /, master feature"))


@query
def filter_extension(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, filters.extension_filter("Java, sql"))


@query
def filter_author(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, filters.author_filter("user 7, user12 com, User user12"))


@query
def filter_date(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, filters.date_filter("2024-01-05", "2024-01-11"))


@query
def filter_date_open(spark: SparkSession, d: str) -> DataFrame:
    """The first day does not exist, so it is no bound."""
    return _kept(spark, d, filters.date_filter("2024-02-30", "2024-01-11"))


@query
def acl_search(spark: SparkSession, d: str) -> DataFrame:
    return _ids(filters.readable(_both(spark, d), src.grants(spark, d), "3"))


@query
def acl_administrator(spark: SparkSession, d: str) -> DataFrame:
    return _ids(filters.readable(_both(spark, d), src.grants(spark, d), None))


@query
def acl_no_grants(spark: SparkSession, d: str) -> DataFrame:
    return _ids(filters.readable(_both(spark, d), src.grants(spark, d), "nobody"))


@query
def readable_repos(spark: SparkSession, d: str) -> DataFrame:
    mine = catalog.readable_repositories(src.repositories(spark, d), src.grants(spark, d), "2")
    return mine.select("project", "repository", "projectname")


@query
def valid_hits(spark: SparkSession, d: str) -> DataFrame:
    """Pages belong to no known repository."""
    files = _files(spark, d).unionByName(src.page_files(spark, d))
    return filters.valid_hits(files, src.repositories(spark, d)).select("doc_id")


@query
def refs_to_index(spark: SparkSession, d: str) -> DataFrame:
    """French repositories use a pattern of their own, Spanish ones a pattern that does not compile."""
    own = F.when(F.col("project") == "fr", "HEAD|refs/heads/feature/.").when(
        F.col("project") == "es", "refs/(heads").otherwise(F.col("ref_regex"))
    repos = src.repositories(spark, d).withColumn("ref_regex", own)
    return catalog.select_refs(src.branches(spark, d), repos).select("project", "repository", "ref")


# --- text match

def _found(spark: SparkSession, d: str, condition, fields=FILE_FIELDS) -> DataFrame:  # noqa: ANN001
    return _files(spark, d).filter(condition.test(fields)).select("doc_id")


@query
def match_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, All(Term("The"), Term("en"), Term("java")))


@query
def match_boolean(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, All(Term("the"), AnyOf(Term("ing"), Term("tion")), Not(Term("md", field="path"))))


@query
def match_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, Wildcard("t?e*ing"))


@query
def match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, Fuzzy("there", field="contents"))


@query
def match_fuzzy_two(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, Fuzzy("nation", field="contents"))


@query
def match_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, Phrase("the of"))


@query
def match_phrase_path(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, Phrase("en/src3", field="path"))


@query
def match_sloppy(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, Phrase("the of and", slop=4))


@query
def match_sloppy_repeat(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, Phrase("the of the", slop=3))


@query
def match_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash of event 7, found as a whole only."""
    whole = "902ba3cda1883801594b6e1b452790cc53948fda"
    condition = AnyOf(Term(whole), Term(whole[:12]), Wildcard("b1d57811*"))
    return _commits(spark, d).filter(condition.test(COMMIT_FIELDS)).select("doc_id", "hash")


@query
def match_message(spark: SparkSession, d: str) -> DataFrame:
    """Words that are not plain ASCII."""
    condition = All(Term("ÉTÉ les"), Not(Phrase("de la", field="body")))
    talk = src.message_commits(spark, d)
    return talk.filter(AnyOf(condition, Phrase("les eau")).test(COMMIT_FIELDS)).select("doc_id")


@query
def match_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, Prefix("thi", field="contents"))


@query
def match_regex(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, Regex("er[aeiou]+[a-z]{0,2}tion", field="contents"))


@query
def match_range(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, TermRange("zu", "zz", field="contents"))


@query
def match_lenient(spark: SparkSession, d: str) -> DataFrame:
    """A bound that is no number matches nothing; the other part still does."""
    return _found(spark, d, AnyOf(NumberRange("charcount", "many"), NumberRange("charcount", "1000", 2000)))


@query
def match_fields(spark: SparkSession, d: str) -> DataFrame:
    """Only file names are searched."""
    return _found(spark, d, Term("java"), file_fields(LIMITS, code=False))


@query
def browse_all(spark: SparkSession, d: str) -> DataFrame:
    found = plan.search(_corpus(spark, d), plan.Search(query=""))
    return found.select("doc_type", "doc_id", "score")


@query
def match_none(spark: SparkSession, d: str) -> DataFrame:
    """How many documents there are and how many an impossible condition finds."""
    impossible = All(Term("the"), Not(AnyOf(Term("the"), Term("of"))))
    hit = impossible.test(FILE_FIELDS).cast("bigint")
    return _files(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.sum(hit).alias("hits"))


@query
def search_numbers(spark: SparkSession, d: str) -> DataFrame:
    """A number that only files have, searched in both types: commits are beyond any bound on it."""
    request = plan.Search(query=Not(Not(NumberRange("charcount", 1000, 2000))), code=True, commits=True)
    return plan.search(_corpus(spark, d), request, scored=False).select("doc_type", "doc_id")


@query
def rank_tfidf(spark: SparkSession, d: str) -> DataFrame:
    request = plan.Search(query="the", code=True)
    return plan.search(_corpus(spark, d), request).select("doc_id", "score")


@query
def rank_boosted(spark: SparkSession, d: str) -> DataFrame:
    request = plan.Search(query="the en", code=True, filenames=True)
    return plan.search(_corpus(spark, d), request).select("doc_id", "score")


@query
def rank_any(spark: SparkSession, d: str) -> DataFrame:
    """Optional parts: the score is scaled by the share of parts that matched."""
    request = plan.Search(query=AnyOf(Term("ing"), Term("sql", boost=2.0), Wildcard("zen*")), code=True, filenames=True)
    return plan.search(_corpus(spark, d), request).select("doc_id", "score")


@query
def rank_phrase(spark: SparkSession, d: str) -> DataFrame:
    request = plan.Search(query=Phrase("the of"), code=True)
    return plan.search(_corpus(spark, d), request).select("doc_id", "score")


# --- the same from stored token rows

_INDEXES: dict[tuple[str, str], TokenIndex] = {}  # one for each session and folder


def _index(spark: SparkSession, d: str) -> TokenIndex:
    """Token rows of all files, commits and messages, written once in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        parts = [(_files(spark, d), FILE_FIELDS), (_commits(spark, d), COMMIT_FIELDS), (src.message_commits(spark, d), COMMIT_FIELDS)]
        _INDEXES[key] = write_index(f"{shared_dir(spark)}/{uuid.uuid4()}/tokens", parts)
    return _INDEXES[key]


def _stored(spark: SparkSession, d: str, condition, docs: DataFrame | None = None, fields=FILE_FIELDS) -> DataFrame:  # noqa: ANN001
    docs = _files(spark, d) if docs is None else docs
    rows, stored = with_evidence(docs, _index(spark, d), condition, fields)
    return rows.filter(condition.test(stored))


def _token_corpus(spark: SparkSession, d: str) -> plan.Corpus:
    index = _index(spark, d)
    numbers = {"file": _files(spark, d).count(), "commit": _commits(spark, d).count()}
    return replace(_corpus(spark, d), tokens=index, vocabulary=index.vocabulary(), documents=numbers)


STORED_CONDITIONS = {
    "all_terms": All(Term("The"), Term("en"), Term("java")),
    "boolean": All(Term("the"), AnyOf(Term("ing"), Term("tion")), Not(Term("md", field="path"))),
    "wildcard": Wildcard("t?e*ing"),
    "fuzzy": Fuzzy("there", field="contents"),
    "fuzzy_two": Fuzzy("nation", field="contents"),
    "phrase": Phrase("the of"),
    "phrase_path": Phrase("en/src3", field="path"),
    "sloppy": Phrase("the of and", slop=4),
    "sloppy_repeat": Phrase("the of the", slop=3),
    "prefix": Prefix("thi", field="contents"),
    "regex": Regex("er[aeiou]+[a-z]{0,2}tion", field="contents"),
    "range": TermRange("zu", "zz", field="contents"),
}


def _stored_match(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _stored(spark, d, STORED_CONDITIONS[name]).select("doc_id")

    run.__name__ = f"stored_match_{name}"
    query(run)


for _name in STORED_CONDITIONS:
    _stored_match(_name)


@query
def stored_match_hash(spark: SparkSession, d: str) -> DataFrame:
    whole = "902ba3cda1883801594b6e1b452790cc53948fda"
    condition = AnyOf(Term(whole), Term(whole[:12]), Wildcard("b1d57811*"))
    return _stored(spark, d, condition, _commits(spark, d), COMMIT_FIELDS).select("doc_id", "hash")


@query
def stored_match_message(spark: SparkSession, d: str) -> DataFrame:
    condition = AnyOf(All(Term("ÉTÉ les"), Not(Phrase("de la", field="body"))), Phrase("les eau"))
    return _stored(spark, d, condition, src.message_commits(spark, d), COMMIT_FIELDS).select("doc_id")


@query
def stored_rank_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return plan.search(_token_corpus(spark, d), plan.Search(query="the", code=True)).select("doc_id", "score")


@query
def stored_rank_boosted(spark: SparkSession, d: str) -> DataFrame:
    request = plan.Search(query="the en", code=True, filenames=True)
    return plan.search(_token_corpus(spark, d), request).select("doc_id", "score")


@query
def stored_rank_any(spark: SparkSession, d: str) -> DataFrame:
    request = plan.Search(query=AnyOf(Term("ing"), Term("sql", boost=2.0), Wildcard("zen*")), code=True, filenames=True)
    return plan.search(_token_corpus(spark, d), request).select("doc_id", "score")


@query
def stored_rank_phrase(spark: SparkSession, d: str) -> DataFrame:
    return plan.search(_token_corpus(spark, d), plan.Search(query=Phrase("the of"), code=True)).select("doc_id", "score")


@query
def stored_top_page(spark: SparkSession, d: str) -> DataFrame:
    request = plan.Search(query="the en", code=True, filenames=True, page=1)
    return plan.search_page(_token_corpus(spark, d), request)


# --- the same through token tables

@query
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return postings.vocabulary(_files(spark, d), FILE_FIELDS)


@query
def field_lengths(spark: SparkSession, d: str) -> DataFrame:
    return postings.field_lengths(_files(spark, d), FILE_FIELDS)


@query
def term_lookup(spark: SparkSession, d: str) -> DataFrame:
    return postings.lookup(postings.postings(_files(spark, d), FILE_FIELDS), ["ing", "java", "tion"])


@query
def index_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return postings.documents_with_all(postings.postings(_files(spark, d), FILE_FIELDS), ["the", "en", "java"])


@query
def index_many_terms(spark: SparkSession, d: str) -> DataFrame:
    """More words than a number has bits."""
    return postings.documents_with_all(postings.postings(_files(spark, d), [CONTENTS]), MANY_WORDS)


@query
def index_phrase(spark: SparkSession, d: str) -> DataFrame:
    return postings.phrase_starts(postings.postings(_files(spark, d), [CONTENTS]), ["the", "of"])


@query
def index_wildcard(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    terms = postings.expand(postings.vocabulary(files, [CONTENTS]), F.col("term").rlike(r"\At.e.*ing\z"), ["contents"])
    return postings.documents_of_terms(postings.postings(files, [CONTENTS]), terms)


# --- statistics

@query
def author_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return statistics.distinct_values(_both(spark, d), "authoremail")


@query
def approximate_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate number of authors lies within five standard errors of the exact one."""
    exact = statistics.distinct_values(_commits(spark, d), "authoremail")
    near = statistics.distinct_values(_commits(spark, d), "authoremail", approximate=True, rsd=0.01)
    apart = F.abs(near.select("cardinality").scalar() - F.col("cardinality"))
    return exact.select("cardinality", (apart <= 0.05 * F.col("cardinality")).alias("near"))


def _merged(spark: SparkSession, docs: DataFrame, column: str) -> DataFrame:
    """Distinct values from stored parts, one for each repository, and whether the number keeps its promise."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4()}/parts"
    statistics.cardinality_parts(docs, column).write.parquet(folder)
    merged = statistics.merged_cardinality(spark.read.parquet(folder)).select("cardinality").scalar()
    n = F.col("cardinality")
    apart = F.when(n <= PRECISION_THRESHOLD, F.lit(0)).otherwise(0.05 * n)
    return statistics.distinct_values(docs, column).select("cardinality", (F.abs(merged - n) <= apart).alias("near"))


@query
def merged_author_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, _commits(spark, d), "authoremail")


@query
def merged_extension_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, _files(spark, d), "extension")


@query
def merged_hash_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """As many values as commits: beyond the threshold on all but the smallest tables."""
    return _merged(spark, _commits(spark, d), "hash")


@query
def approximate_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Whether a thousandth of the documents at most lies between each approximate percentile and its rank."""
    files = _files(spark, d)
    rows = statistics.percentiles(files, "charcount", approximate=True).collect()  # seven
    x, n = F.col("charcount"), F.count("charcount")
    checks = [
        F.struct(F.lit(float(r["percentile"])).alias("percentile"), (
            (F.count_if(x < r["value"]) <= (r["percentile"] / 100 + 1e-3) * n)
            & (F.count_if(x <= r["value"]) >= (r["percentile"] / 100 - 1e-3) * n)).alias("near"))
        for r in rows
    ]
    return files.agg(F.array(*checks).alias("checks")).select(F.explode("checks").alias("c")).select("c.*")


@query
def extension_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return statistics.distinct_values(_both(spark, d), "extension")


@query
def author_ranking(spark: SparkSession, d: str) -> DataFrame:
    return statistics.top(statistics.counts(_both(spark, d), "authoremail"))


@query
def extension_ranking(spark: SparkSession, d: str) -> DataFrame:
    return statistics.top(statistics.counts(_both(spark, d), "extension"))


@query
def ranking_with_other(spark: SparkSession, d: str) -> DataFrame:
    ranked = statistics.ranking(statistics.counts(_both(spark, d), "authoremail"))
    return ranked.withColumn("proportion", F.round("proportion", 9))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in columns})


@query
def charcount_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.percentiles(_both(spark, d), "charcount"), "value")


@query
def linecount_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.percentiles(_both(spark, d), "linecount"), "value")


@query
def charcount_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.extended_stats(_both(spark, d), "charcount"), "avg", "variance", "std_deviation")


@query
def linecount_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.extended_stats(_both(spark, d), "linecount"), "avg", "variance", "std_deviation")


@query
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return statistics.type_counts(_both(spark, d))


@query
def search_statistics(spark: SparkSession, d: str) -> DataFrame:
    request = plan.Search(query=AnyOf(Term("the"), Term("click")))
    return plan.search_statistics(_corpus(spark, d), request)


@query
def total_hits(spark: SparkSession, d: str) -> DataFrame:
    request = plan.Search(query="the", projects="en,de", user="1")
    return statistics.total_hits(plan.search(_corpus(spark, d, acl=True), request, scored=False))


# --- pages

@query
def top_page(spark: SparkSession, d: str) -> DataFrame:
    request = plan.Search(query="the en", code=True, filenames=True, page=1)
    return plan.search_page(_corpus(spark, d), request)


@query
def search_answer(spark: SparkSession, d: str) -> DataFrame:
    corpus = replace(_corpus(spark, d), repositories=src.repositories(spark, d))
    return plan.search_answer(corpus, plan.Search(query="the en", code=True, filenames=True, page=1))


@query
def next_page(spark: SparkSession, d: str) -> DataFrame:
    """The page after the last hit of the first one, found without counting through it."""
    found = plan.search(_corpus(spark, d), plan.Search(query="the en", code=True, filenames=True))
    found = found.select("doc_type", "doc_id", "project", "repository", "score")
    last = ranking.page_of(found, 0, LIMITS.page_size).orderBy("score", F.desc("doc_id")).first()
    return ranking.page_after(found, last["score"], last["doc_id"], LIMITS.page_size)


@query
def page_bounds(spark: SparkSession, d: str) -> DataFrame:
    found = plan.search(_corpus(spark, d), plan.Search(query="the", code=True), scored=False)
    return ranking.page_bounds(found, 2, LIMITS.page_size)


# --- snippets

@query
def split_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _files(spark, d).unionByName(src.page_files(spark, d))
    return rows.select("doc_id", F.posexplode(tx.lines("contents")).alias("line_no", "line"))


@query
def highlight_terms(spark: SparkSession, d: str) -> DataFrame:
    forms = matched_forms(All(Term("the"), Term("of")), CONTENTS, LIMITS.max_fragments)
    return _files(spark, d).select("doc_id", _joined(forms).alias("forms"))


def _the(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    return _files(spark, d), matched_forms(Term("this"), CONTENTS, LIMITS.max_fragments)


@query
def match_lines(spark: SparkSession, d: str) -> DataFrame:
    files, forms = _the(spark, d)
    lines = files.select("doc_id", tx.lines("contents").alias("lines"), forms.alias("forms"))
    flagged = lines.select("doc_id", F.posexplode(F.arrays_zip(
        snippets.line_matches(F.col("lines"), F.col("forms")).alias("hit"))).alias("line_no", "f"))
    return flagged.filter("f.hit").select("doc_id", "line_no")


@query
def preview_lines(spark: SparkSession, d: str) -> DataFrame:
    return snippets.snippet_rows(_files(spark, d), None, preview=LIMITS.max_preview_lines)


@query
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return snippets.snippet_rows(*_the(spark, d), preview=LIMITS.max_preview_lines, limit=LIMITS.max_match_lines)


@query
def snippet_text(spark: SparkSession, d: str) -> DataFrame:
    shown = snippets.with_snippets(*_the(spark, d), preview=LIMITS.max_preview_lines, limit=LIMITS.max_match_lines)
    return shown.select("doc_id", "source_lines", "source_line_nums", "is_preview", "shown_lines", "excess_lines")


@query
def search_with_snippets(spark: SparkSession, d: str) -> DataFrame:
    """A whole request: match, filter, rank, cut the page, show lines."""
    request = plan.Search(query="this the", code=True, filenames=True, extensions="py,java", user="1")
    shown = plan.search_snippets(_corpus(spark, d, acl=True), request)
    return shown.select(
        "doc_id", "primary_ref", "extension", "no_highlight", "score", "source_lines", "source_line_nums",
        "is_preview", "shown_lines", "excess_lines",
    )


@query
def search_commit_hits(spark: SparkSession, d: str) -> DataFrame:
    request = plan.Search(query="purchase", commits=True, authors="user 7,user12", after="2024-01-03")
    shown = plan.search_commits(_corpus(spark, d), request)
    return shown.withColumn("refs", _joined("refs"))


# --- maintenance

@query
def add_ref(spark: SparkSession, d: str) -> DataFrame:
    docs = deltas.add_ref(_files(spark, d), src.DEVELOP, F.col("extension") == "py")
    return docs.select("doc_id", _joined(keys.display_refs()).alias("refs"))


@query
def remove_ref(spark: SparkSession, d: str) -> DataFrame:
    docs = deltas.remove_ref(_files(spark, d), src.FEATURE_B)
    return docs.select("doc_id", _joined("refs").alias("refs"))


@query
def docs_to_insert(spark: SparkSession, d: str) -> DataFrame:
    changes = deltas.file_changes(tree_delta(spark, d))
    return deltas.documents_to_insert(_files(spark, d), changes).select(
        "doc_id", _joined(F.array_sort("add_refs")).alias("add_refs"))


def _shape(files: DataFrame) -> DataFrame:
    return files.select(
        "doc_id", _joined("refs").alias("refs"), "extension", "charcount", "linecount",
        F.sha1("contents").alias("digest"),
    )


@query
def apply_delta(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the old tip brought to the new one."""
    blobs = src.blobs(spark, d)
    before = snapshots.build_files(snapshots.documents_of_tree(src.tree(spark, d, src.OLD_TIP)), blobs, LIMITS)
    return _shape(indexing.apply_delta(before, tree_delta(spark, d), blobs, LIMITS))


@query
def apply_commit_delta(spark: SparkSession, d: str) -> DataFrame:
    log = src.commit_log(spark, d)
    before = snapshots.build_commits(snapshots.commits_of_reach(src.reach(spark, d, src.OLD_TIP)), log)
    old, new = src.reach(spark, d, src.OLD_TIP), src.reach(spark, d, src.NEW_TIP)
    after = indexing.apply_commit_delta(before, *deltas.commit_delta(old, new), log)
    return after.select("doc_id", _joined("refs").alias("refs"), "authoremail", "subject", "body")


@query
def reindex_ref(spark: SparkSession, d: str) -> DataFrame:
    files = indexing.reindex_ref(
        _files(spark, d), src.tree(spark, d, src.NEW_TIP), src.blobs(spark, d), "es", "src4", src.MASTER, LIMITS)
    return _shape(files)


@query
def repo_purge(spark: SparkSession, d: str) -> DataFrame:
    return _ids(indexing.purge_repository(_both(spark, d), "en", "src5"))


def _sources(spark: SparkSession, d: str) -> indexing.Sources:
    tips = src.tree(spark, d, src.NEW_TIP).select("project", "repository", "ref").distinct()
    return indexing.Sources(
        src.repositories(spark, d), tips.withColumn("tip", F.sha1(keys.ref_key())),
        src.tree(spark, d, src.NEW_TIP), src.blobs(spark, d),
        src.reach(spark, d, src.NEW_TIP), src.commit_log(spark, d),
    )


@query
def full_build(spark: SparkSession, d: str) -> DataFrame:
    return _shape(indexing.build(_sources(spark, d), LIMITS)[0])


@query
def full_build_commits(spark: SparkSession, d: str) -> DataFrame:
    commits = indexing.build(_sources(spark, d), LIMITS)[1]
    return hits.commit_hits(commits).withColumn("refs", _joined("refs"))


def _old_sources(spark: SparkSession, d: str) -> indexing.Sources:
    refs = src.tree(spark, d, src.OLD_TIP).select("project", "repository", "ref").distinct()
    return replace(
        _sources(spark, d), branches=refs.withColumn("tip", F.sha1(F.concat(keys.ref_key(), F.lit("old")))),
        tree=src.tree(spark, d, src.OLD_TIP), reach=src.reach(spark, d, src.OLD_TIP))


def _store(spark: SparkSession) -> DocumentStore:
    return DocumentStore(spark, f"{shared_dir(spark)}/{uuid.uuid4()}/store", Buckets(4, 4))


@query
def store_update(spark: SparkSession, d: str) -> DataFrame:
    """A store of the old tips brought to the new ones; branches without a new tip go."""
    store = _store(spark)
    indexing.full_build(store, _old_sources(spark, d), LIMITS)
    indexing.update_all(store, _sources(spark, d), LIMITS)
    return _shape(store.read("files"))


def _updated_store(spark: SparkSession, d: str) -> DocumentStore:
    """A store with token rows of the old tips, brought to the new ones."""
    store = _store(spark)
    indexing.full_build(store, _old_sources(spark, d), LIMITS, tokens=True)
    indexing.update_all(store, _sources(spark, d), LIMITS)
    return store


@query
def stored_update_rank(spark: SparkSession, d: str) -> DataFrame:
    """Scores after an update, from token rows and word counts that the update appended to."""
    corpus = plan.stored_corpus(_updated_store(spark, d), tokens=True)
    return plan.search(corpus, plan.Search(query="the en", code=True, filenames=True)).select("doc_id", "score")


@query
def stored_update_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies after an update: what came and went is added up."""
    words = plan.stored_corpus(_updated_store(spark, d), tokens=True).vocabulary
    return words.filter(F.col("field").isin("contents", "path"))


@query
def store_purge(spark: SparkSession, d: str) -> DataFrame:
    """A repository that the catalog no longer lists is deleted, another one is begun anew."""
    store, sources = _store(spark), _sources(spark, d)
    indexing.full_build(store, sources, LIMITS)
    listed = replace(sources, branches=indexing.purge_repository(sources.branches, "en", "src5"))
    gone = spark.createDataFrame([("en", "src5"), ("de", "src6")], "project string, repository string")
    indexing.sync_refs(store, listed, sources.branches.limit(0), LIMITS, gone)
    return _shape(store.read("files"))


@query
def store_reindex_repository(spark: SparkSession, d: str) -> DataFrame:
    store, sources = _store(spark), _sources(spark, d)
    indexing.full_build(store, sources, LIMITS)
    indexing.reindex_repository(store, sources, "es", "src4", LIMITS)
    return _shape(store.read("files"))


@query
def store_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """What is indexed after an update: the new tip of every selected ref."""
    store = _store(spark)
    indexing.full_build(store, _old_sources(spark, d), LIMITS)
    indexing.update_all(store, _sources(spark, d), LIMITS)
    return store.read("checkpoints").select("project", "repository", "ref", "hash")


# --- events

@query
def stream_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return updates.coalesce_events(src.ref_events(spark, d))


@query
def stream_route(spark: SparkSession, d: str) -> DataFrame:
    changes = updates.coalesce_events(src.ref_events(spark, d))
    routed = updates.route_events(changes, src.branches(spark, d))
    return routed.select("project", "repository", "ref", "action")


@query
def stream_pending(spark: SparkSession, d: str) -> DataFrame:
    """The last change of every ref, kept by a streaming query over the events."""
    run = f"{shared_dir(spark)}/{uuid.uuid4()}"
    raw = spark.readStream.schema(src.COLUMNS["events"]).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = updates.pending_changes(src.shape_ref_events(raw), f"{run}/state", f"{run}/progress")
    stream.awaitTermination()
    return updates.pending_state(spark, f"{run}/state")


def _halves(spark: SparkSession, d: str) -> list[DataFrame]:
    events, cut = src.table(spark, d, "events"), F.lit(src.CUT)
    return [events.filter(F.col("ts") < cut), events.filter(F.col("ts") >= cut)]


@query
def stream_pending_restart(spark: SparkSession, d: str) -> DataFrame:
    """The same from two runs of the streaming query: the second one finds the state of the first."""
    run = f"{shared_dir(spark)}/{uuid.uuid4()}"
    for half in _halves(spark, d):
        half.write.mode("append").parquet(f"{run}/events")
        raw = spark.readStream.schema(src.COLUMNS["events"]).parquet(f"{run}/events")
        updates.pending_changes(src.shape_ref_events(raw), f"{run}/state", f"{run}/progress").awaitTermination()
    return updates.pending_state(spark, f"{run}/state")


@query
def stream_store(spark: SparkSession, d: str) -> DataFrame:
    """A store of the old tips kept current by a stream of ref events, which stops and is started again.

    Each of the two runs is one batch. Refs without an event stay at their old tip.
    """
    store, sources = _store(spark), _sources(spark, d)
    indexing.full_build(store, _old_sources(spark, d), LIMITS)
    run = f"{shared_dir(spark)}/{uuid.uuid4()}"
    for half in _halves(spark, d):
        half.write.mode("append").parquet(f"{run}/events")
        raw = spark.readStream.schema(src.COLUMNS["events"]).parquet(f"{run}/events")
        stream = updates.run_updates(src.shape_ref_events(raw), store, lambda: sources, LIMITS, f"{run}/progress")
        stream.awaitTermination()
    return _shape(store.read("files"))


@query
def index_gate(spark: SparkSession, d: str) -> DataFrame:
    """With indexing switched off neither a build, an update nor a reindex changes the documents."""
    store, sources, off = _store(spark), _sources(spark, d), replace(LIMITS, indexing_enabled=False)
    indexing.full_build(store, _old_sources(spark, d), LIMITS)
    indexing.full_build(store, sources, off)
    indexing.update_all(store, sources, off)
    indexing.reindex_repository(store, sources, "es", "src4", off)
    return _shape(store.read("files"))
