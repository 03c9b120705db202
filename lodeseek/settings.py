"""Limits and boosts, checked on construction."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Fixed values: (lowest, highest) accepted for each numeric setting.
BOUNDS = {
    "max_file_size": (1_024, 16_777_216),
    "search_timeout_ms": (1_000, 300_000),
    "max_preview_lines": (1, 10_000),
    "max_match_lines": (1, 10_000),
    "max_fragments": (1, 10_000),
    "page_size": (5, 1_000),
    "commit_hash_boost": (0.01, 100.0),
    "commit_subject_boost": (0.01, 100.0),
    "commit_body_boost": (0.01, 100.0),
    "file_name_boost": (0.01, 100.0),
}

# Fixed value: which refs are indexed unless a repository says otherwise.
DEFAULT_REF_REGEX = "HEAD|(refs/heads/(master|develop))"

# The percentiles and ranking length of the statistics block.
PERCENTILES = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)
RANKING_SIZE = 25

# Fixed value: numbers of distinct values up to this one are exact.
PRECISION_THRESHOLD = 1000


@dataclass(frozen=True)
class Limits:
    indexing_enabled: bool = False
    max_file_size: int = 262_144
    search_timeout_ms: int = 10_000
    no_highlight_extensions: str = "txt,log"
    max_preview_lines: int = 10
    max_match_lines: int = 50
    max_fragments: int = 50
    page_size: int = 50
    commit_hash_boost: float = 100.0
    commit_subject_boost: float = 4.0
    commit_body_boost: float = 2.0
    file_name_boost: float = 5.0

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name not in BOUNDS:
                continue
            low, high = BOUNDS[f.name]
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"{f.name} must be a number, not {value!r}")
            if isinstance(low, int) and not isinstance(value, int):
                raise ValueError(f"{f.name} must be a whole number, not {value!r}")
            if not low <= value <= high:
                raise ValueError(f"{f.name} must lie in {low}..{high}, not {value!r}")


def split_list(text: str | None) -> list[str]:
    """Comma list -> trimmed, non-empty items."""
    return [item.strip() for item in (text or "").split(",") if item.strip()]
