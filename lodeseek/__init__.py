"""Search and analytics over versioned text corpora, as Spark jobs."""

from lodeseek.plans.search import (
    Corpus, Search, search, search_commits, search_page, search_snippets, search_statistics, stored_corpus,
)
from lodeseek.settings import Limits

__all__ = [
    "Corpus", "Limits", "Search", "search", "search_commits", "search_page", "search_snippets", "search_statistics",
    "stored_corpus",
]
