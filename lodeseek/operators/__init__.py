"""Relational building blocks: filters, text match, ranking, snippets, statistics, merges."""
