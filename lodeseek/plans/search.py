"""A search request: matches, one page of hits, snippets, statistics."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.keys import Buckets
from lodeseek.operators import filters as flt
from lodeseek.operators import hits as shape
from lodeseek.operators import ranking, snippets, statistics
from lodeseek.operators.occurrences import TokenIndex, with_evidence
from lodeseek.operators.match import Condition, Field, all_terms, commit_fields, file_fields, matched_forms
from lodeseek.schemas import APPENDED
from lodeseek.settings import Limits
from lodeseek.sources.store import DocumentStore

T = TypeVar("T")

# Columns of a match: enough for paging and statistics, and no text.
FACET_TYPES = {"authoremail": "string", "extension": "string", "charcount": "int", "linecount": "int"}
NARROW = ("doc_type", "doc_id", "project", "repository", "score", *FACET_TYPES)


@dataclass(frozen=True)
class Search:
    """What is looked for. Lists are comma separated; empty means not restricted."""

    query: Condition | str | None = None
    code: bool = False
    filenames: bool = False
    commits: bool = False
    projects: str = ""
    repositories: str = ""
    refs: str = ""
    extensions: str = ""
    authors: str = ""
    after: str = ""
    before: str = ""
    user: str | None = None  # None is an administrator
    page: int | str = 0
    limits: Limits = field(default_factory=Limits)

    @property
    def condition(self) -> Condition:
        return self.query if isinstance(self.query, Condition) else all_terms(self.query)

    @property
    def switches(self) -> tuple[bool, bool, bool]:
        chosen = (self.code, self.filenames, self.commits)
        return chosen if any(chosen) else (True, True, True)


@dataclass(frozen=True)
class Corpus:
    """The tables a search reads. ``grants`` may be left out for administrators."""

    files: DataFrame
    commits: DataFrame
    repositories: DataFrame | None = None
    grants: DataFrame | None = None
    vocabulary: DataFrame | None = None
    documents: dict[str, int] | None = None  # per type, behind ``vocabulary``
    buckets: Buckets | None = None  # how stored tables are split
    tokens: TokenIndex | None = None  # token rows that are searched in place of the texts


def stored_corpus(
    store: DocumentStore, repositories: DataFrame | None = None, grants: DataFrame | None = None,
    version: int | None = None, tokens: bool = False,
) -> Corpus:
    """The tables of a stored version, with its vocabulary where one was written.

    With ``tokens`` searches read the version's token rows and no texts; a version without them is refused.
    """
    version = store.latest() if version is None else version
    index = None
    if tokens:
        if not store.has_tokens(version):
            raise ValueError(f"version {version} has no token rows: build it with full_build(..., tokens=True)")
        index = TokenIndex(**{name: store.read_appended(name, version) for name in APPENDED})
    vocabulary = index.vocabulary() if index else store.vocabulary(version)
    documents = None
    files, commits = store.read("files", version), store.read("commits", version)
    if vocabulary is not None:
        documents = {flt.FILE: files.count(), flt.COMMIT: commits.count()}  # from file footers
    return Corpus(files, commits, repositories, grants, vocabulary, documents, store.buckets, index)


def _parts(corpus: Corpus, request: Search) -> list[tuple[str, DataFrame, list[Field]]]:
    code, filenames, commits = request.switches
    parts = []
    if code or filenames:
        parts.append((flt.FILE, corpus.files, file_fields(request.limits, code, filenames)))
    if commits:
        parts.append((flt.COMMIT, corpus.commits, commit_fields(request.limits)))
    return parts


def _statistics(corpus: Corpus, request: Search) -> Column | None:
    condition = request.condition
    parts = [(df, fields) for _, df, fields in _parts(corpus, request)]
    if not any(leaf.weighted(f) for leaf in condition.leaves() for _, fs in parts for f in leaf.among(fs)):
        return None
    if corpus.vocabulary is not None and corpus.documents is not None:
        documents = sum(corpus.documents[doc_type] for doc_type, _, _ in _parts(corpus, request))
        return ranking.vocabulary_statistics(corpus.vocabulary, documents, parts, condition)
    return ranking.term_statistics(parts, condition)


def _filtered(df: DataFrame, doc_type: str, corpus: Corpus, request: Search) -> DataFrame:
    df = flt.keep(
        df,
        flt.project_filter(request.projects), flt.repository_filter(request.repositories),
        flt.extension_filter(request.extensions, doc_type), flt.author_filter(request.authors, doc_type),
        flt.date_filter(request.after, request.before, doc_type), flt.ref_filter(request.refs),
    )
    if corpus.buckets:
        df = flt.keep(df, flt.bucket_list_filter(request.projects, request.repositories, corpus.buckets))
    if request.user is not None:
        if corpus.grants is None:
            raise ValueError("a search for one user needs the grants table")
        df = flt.readable(df, corpus.grants, request.user, corpus.buckets)
    if corpus.repositories is not None:
        df = flt.valid_hits(df, corpus.repositories)
    return df


def search(corpus: Corpus, request: Search, scored: bool = True) -> DataFrame:
    """All matching documents with their score, without any text columns."""
    stats = _statistics(corpus, request) if scored else None
    found = []
    for doc_type, df, fields in _parts(corpus, request):
        df = _filtered(df, doc_type, corpus, request)
        # A part without a number column is beyond any bound on it.
        absent = request.condition.number_columns()
        df = df.withColumns({c: F.lit(None).cast("double") for c in absent if c not in df.columns})
        if corpus.tokens is not None:
            df, fields = with_evidence(df, corpus.tokens, request.condition, fields)
        df = df.filter(request.condition.test(fields))
        df = ranking.with_score(df, request.condition, fields, stats) if scored else df.withColumn("score", F.lit(1.0))
        df = df.withColumn("doc_type", F.lit(doc_type))
        missing = {c: F.lit(None).cast(kind) for c, kind in FACET_TYPES.items() if c not in df.columns}
        found.append(df.withColumns(missing).select(*NARROW))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def search_page(corpus: Corpus, request: Search) -> DataFrame:
    """The requested page of (doc_type, doc_id, project, repository, score)."""
    columns = ("doc_type", "doc_id", "project", "repository", "score")
    return ranking.page_of(search(corpus, request).select(*columns), request.page, request.limits.page_size)


def search_answer(corpus: Corpus, request: Search) -> DataFrame:
    """The page with readable names, and on each of its rows the total, the pages and the window shown.

    Needs the repositories of the corpus; hits of unknown ones are no hits. The columns of
    ``search_page``, then ``projectname, repositoryname, total_hits, pages, result_from, result_to``.
    """
    if corpus.repositories is None:
        raise ValueError("an answer with names needs the repositories table")
    bounds = ranking.page_bounds(search(corpus, request, scored=False), request.page, request.limits.page_size)
    whole = bounds.select(F.struct("*").alias("bounds")).scalar()
    page = shape.with_names(search_page(corpus, request), corpus.repositories).withColumn("bounds", whole)
    return page.select("*", "bounds.*").drop("bounds")


def within_timeout(spark: SparkSession, limits: Limits, answer: Callable[[], T]) -> T:
    """What ``answer`` returns; its jobs are cancelled after ``limits.search_timeout_ms``, with a ``TimeoutError``."""
    context, tag, late = spark.sparkContext, f"search-{uuid.uuid4()}", threading.Event()

    def cancel() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(limits.search_timeout_ms / 1000, cancel)
    context.addJobTag(tag)
    timer.start()
    try:
        return answer()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"no answer within {limits.search_timeout_ms} ms") from error
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def _of_page(df: DataFrame, page: DataFrame, doc_type: str, buckets: Buckets | None) -> DataFrame:
    # A page has at most limits.page_size <= 1000 narrow rows, whatever matched.
    ids = page.filter(F.col("doc_type") == doc_type).select("doc_id", "project", "repository", "score")
    key = ["doc_id", "project", "repository"]
    if buckets:  # only the buckets of the page are scanned
        ids, key = ids.withColumn("bucket", buckets.of("doc_id")), [*key, "bucket"]
    return df.join(F.broadcast(ids), key)


def search_snippets(corpus: Corpus, request: Search, page: DataFrame | None = None) -> DataFrame:
    """File hits of the page with their snippets; contents are read for these hits only."""
    limits = request.limits
    page = search_page(corpus, request) if page is None else page
    files = _of_page(corpus.files, page, flt.FILE, corpus.buckets)
    code = request.switches[0]
    forms = matched_forms(request.condition, Field("contents", "code"), limits.max_fragments) if code else None
    with_lines = snippets.with_snippets(files, forms, 1, limits.max_preview_lines, limits.max_match_lines)
    extra = ["score", "source_lines", "source_line_nums", "is_preview", "shown_lines", "excess_lines"]
    return with_lines.select(*shape.file_hit_columns(limits.no_highlight_extensions), *extra)


def search_commits(corpus: Corpus, request: Search, page: DataFrame | None = None) -> DataFrame:
    """Commit hits of the page."""
    page = search_page(corpus, request) if page is None else page
    commits = _of_page(corpus.commits, page, flt.COMMIT, corpus.buckets)
    return commits.select(*shape.commit_hit_columns(), "score")


def search_statistics(corpus: Corpus, request: Search) -> DataFrame:
    return statistics.statistics(search(corpus, request, scored=False))
