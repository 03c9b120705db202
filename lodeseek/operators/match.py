"""Full-text conditions, composed in Python and evaluated inside one scan.

A condition becomes a predicate on a single row, so matching needs no shuffle whatever the
share of documents that hold a word. Code text is searched in place with a word-boundary
pattern; the shorter fields are compared as token arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.functions.columns import all_of, any_of, let, literals, text
from lodeseek.functions.text import SEPARATORS, surface_tokens, token_string, tokens
from lodeseek.settings import Limits

# Java's \\w is ASCII, the alphabet of code tokens.
_END = r"(?!\w)"


def _start(first: str) -> str:
    """A pattern of fixed length at the start of a token. The look-behind comes after it, so the
    search only looks back where the pattern was found."""
    return rf"(?i){first}(?<!\w{first})"


@dataclass(frozen=True)
class Field:
    """A searchable column."""

    name: str
    analyzer: str
    boost: float = 1.0

    @property
    def text(self) -> Column:
        return text(self.name)

    @property
    def tokens(self) -> Column:
        return tokens(self.name, self.analyzer)

    def analyze(self, query: str) -> list[str]:
        """Query text cut the way this field is cut (driver side, a few words)."""
        if self.analyzer == "exact":
            return [query] if query else []
        pattern = SEPARATORS[self.analyzer]
        if self.analyzer == "message":
            pattern = r"\W+"
        return [t.lower() for t in re.split(pattern, query) if t]

    def _may_have(self, token: str) -> Column:
        # A cheap test before the text is cut. Lower-casing a whole text may differ from
        # lower-casing its tokens in the final form of a Greek letter only.
        return F.lower(self.text).contains(token) if token.isascii() else F.lit(True)

    def has(self, token: str) -> Column:
        if self.analyzer == "exact":
            return self.text == token
        if self.analyzer == "code":
            return self.text.rlike(_start(token) + _END)
        return self._may_have(token) & F.array_contains(self.tokens, token)

    def count(self, token: str) -> Column:
        if self.analyzer == "exact":
            return (self.text == token).cast("int")
        if self.analyzer == "code":
            return F.regexp_count(self.text, F.lit(_start(token) + _END))
        return F.size(F.filter(self.tokens, lambda t: t == token))

    def length(self) -> Column:
        if self.analyzer == "exact":
            return F.lit(1)
        if self.analyzer == "code":
            return F.regexp_count(self.text, F.lit(r"\w+"))
        return F.size(self.tokens)

    def has_run(self, run: Sequence[str]) -> Column:
        """Tokens at consecutive positions."""
        if len(run) == 1:
            return self.has(run[0])
        if self.analyzer == "code":
            return self.text.rlike(_start(run[0]) + "".join(rf"\W+{t}" for t in run[1:]) + _END)
        joined = token_string(self.tokens).contains("\0" + "\0".join(run) + "\0")
        return all_of(self._may_have(t) for t in run) & joined

    def count_run(self, run: Sequence[str]) -> Column:
        if len(run) == 1:
            return self.count(run[0])
        if self.analyzer == "code":
            # The tail stays in a look-ahead so that overlapping runs all count.
            rest = "".join(rf"\W+{t}" for t in run[1:])
            return F.regexp_count(self.text, F.lit(f"{_start(run[0])}(?={rest}{_END})"))

        def starts(toks: Column) -> Column:
            here = lambda t, i: all_of(F.get(toks, i + k) == w for k, w in enumerate(run))
            return F.size(F.filter(F.transform(toks, here), lambda hit: hit))

        return let(self.tokens, starts)

    def has_near(self, run: Sequence[str], slop: int) -> Column:
        """Some choice of distinct positions with max(pos - slot) - min(pos - slot) <= slop."""
        return all_of(self.has(t) for t in dict.fromkeys(run)) & let(
            self.tokens, lambda toks: _near(toks, run, slop)
        )

    def has_like(self, wildcard: str) -> Column:
        if self.analyzer == "code":
            if not re.fullmatch(r"[A-Za-z0-9_?*]+", wildcard):
                return F.lit(False)
            # No boundary is needed on a side where the pattern has a star.
            parts = [p.replace("?", r"\w") for p in wildcard.split("*")]
            inner = [p for p in parts if p] or [r"\w"]
            head = _start(inner[0]) if parts[0] else "(?i)" + inner[0]
            tail = "".join(rf"\w*{p}" for p in inner[1:])
            return self.text.rlike(head + tail + (_END if parts[-1] else ""))
        return self.any_token(lambda t: t.rlike(rf"(?s)\A(?:{wildcard_body(wildcard)})\z"))

    def any_token(self, test: Callable[[Column], Column]) -> Column:
        return F.exists(self.tokens, test)

    def meets(self, leaf: Condition) -> Column:
        """Some token is one that a wildcard, pattern, range or fuzzy word stands for."""
        if isinstance(leaf, Wildcard):
            return self.has_like(leaf.pattern)
        return self.any_token(leaf.word_test(self))


def wildcard_body(pattern: str) -> str:
    return "".join({"?": ".", "*": ".*"}.get(c, re.escape(c)) for c in pattern.lower())


def _near(toks: Column, run: Sequence[str], slop: int) -> Column:
    """Slide over the positions of the words only; every look goes at most ``slop`` further."""
    words = list(dict.fromkeys(run))
    spots = F.filter(
        F.transform(toks, lambda t, i: F.when(t.isin(words), i)), lambda i: i.isNotNull()
    )

    def fits(low: Column) -> Column:
        # Slot k may sit at low+k .. low+k+slop. Equal words take the earliest free position.
        last: dict[str, Column] = {}
        found = []
        for slot, word in enumerate(run):
            start = F.greatest(low + slot, F.lit(0))
            if word in last:
                start = F.greatest(start, last[word] + 1)
            room = F.greatest(low + (slot + slop + 1) - start, F.lit(0))
            offset = F.array_position(F.slice(toks, start + 1, room), word).cast("int")
            found.append(offset > 0)
            if word in run[slot + 1:]:
                last[word] = F.when(offset > 0, start + offset - 1).otherwise(F.lit(2**30))
        return all_of(found)

    def spot_fits(i: Column) -> Column:
        return any_of(
            (F.get(toks, i) == word) & fits(i - slot) for slot, word in enumerate(run)
        )

    return F.exists(spots, spot_fits)


def file_fields(limits: Limits, code: bool = True, filenames: bool = True) -> list[Field]:
    path = [Field("path", "path", limits.file_name_boost)] if filenames else []
    return path + ([Field("contents", "code")] if code else [])


def commit_fields(limits: Limits) -> list[Field]:
    return [
        Field("subject", "message", limits.commit_subject_boost),
        Field("hash", "exact", limits.commit_hash_boost),
        Field("body", "message", limits.commit_body_boost),
    ]


class Condition:
    """A text condition; combine with ``All``, ``AnyOf`` and ``Not``."""

    field: str | None = None
    optional = False  # whether a document may match without matching every part

    def test(self, fields: Sequence[Field]) -> Column:
        """True for rows where some chosen field meets the condition."""
        return any_of(self.in_field(f) for f in self.among(fields))

    def among(self, fields: Sequence[Field]) -> list[Field]:
        return [f for f in fields if self.field in (None, f.name)]

    def in_field(self, field: Field) -> Column:
        raise NotImplementedError

    def leaves(self) -> list[Condition]:
        """Conditions that add to the score."""
        return [self]

    def number_columns(self) -> list[str]:
        """Number columns that the condition compares."""
        return []

    def weighted(self, field: Field) -> list[str]:
        """Tokens whose document frequency the score needs; none means a constant score."""
        return []

    def frequency(self, field: Field) -> Column:
        return F.lit(1)

    def word_test(self, field: Field) -> Callable[[Column], Column] | None:
        """What a single token of the field must meet; None if none can."""
        raise NotImplementedError


@dataclass(frozen=True)
class Term(Condition):
    """Every token of ``words`` in one field."""

    words: str
    field: str | None = None
    boost: float = 1.0

    def in_field(self, field: Field) -> Column:
        wanted = field.analyze(self.words)
        return all_of(field.has(t) for t in wanted) if wanted else F.lit(False)

    def weighted(self, field: Field) -> list[str]:
        return field.analyze(self.words)


@dataclass(frozen=True)
class Phrase(Condition):
    """Tokens one after the other; with ``slop``, near each other."""

    words: str
    slop: int = 0
    field: str | None = None
    boost: float = 1.0

    def in_field(self, field: Field) -> Column:
        run = field.analyze(self.words)
        if not run:
            return F.lit(False)
        return field.has_near(run, self.slop) if self.slop else field.has_run(run)

    def weighted(self, field: Field) -> list[str]:
        return field.analyze(self.words)

    def frequency(self, field: Field) -> Column:
        return F.lit(1) if self.slop else field.count_run(field.analyze(self.words))


@dataclass(frozen=True)
class Wildcard(Condition):
    """One token against a pattern of ``?`` and ``*``."""

    pattern: str
    field: str | None = None
    boost: float = 1.0

    def in_field(self, field: Field) -> Column:
        return field.meets(self)

    def word_test(self, field: Field) -> Callable[[Column], Column] | None:
        if field.analyzer == "code" and not re.fullmatch(r"[A-Za-z0-9_?*]+", self.pattern):
            return None
        return lambda t: t.rlike(rf"(?s)\A(?:{wildcard_body(self.pattern)})\z")


def Prefix(start: str, field: str | None = None, boost: float = 1.0) -> Wildcard:  # noqa: N802
    return Wildcard(start + "*", field, boost)


@dataclass(frozen=True)
class Regex(Condition):
    """One whole token against a Java regular expression."""

    pattern: str
    field: str | None = None
    boost: float = 1.0

    def __post_init__(self) -> None:
        context = SparkContext._active_spark_context
        if context is None:
            return
        try:
            context._jvm.java.util.regex.Pattern.compile(self.pattern)
        except IllegalArgumentException as error:
            raise ValueError(f"not a regular expression: {self.pattern}") from error

    def in_field(self, field: Field) -> Column:
        return field.meets(self)

    def word_test(self, field: Field) -> Callable[[Column], Column]:
        return lambda t: t.rlike(rf"\A(?:{self.pattern})\z")


@dataclass(frozen=True)
class TermRange(Condition):
    """One token between two others, ends included; an open end is ``None``."""

    low: str | None
    high: str | None
    field: str | None = None
    boost: float = 1.0

    def in_field(self, field: Field) -> Column:
        return field.meets(self)

    def word_test(self, field: Field) -> Callable[[Column], Column]:
        def within(t: Column) -> Column:
            above = t >= self.low.lower() if self.low is not None else F.lit(True)
            return above & (t <= self.high.lower() if self.high is not None else F.lit(True))

        return within


@dataclass(frozen=True)
class NumberRange(Condition):
    """A number column between two bounds. A bound that is not a number matches nothing."""

    column: str
    low: str | float | None = None
    high: str | float | None = None
    boost: float = 1.0

    def number_columns(self) -> list[str]:
        return [self.column]

    def among(self, fields: Sequence[Field]) -> list[Field]:
        return []

    def test(self, fields: Sequence[Field]) -> Column:
        value = F.col(self.column)
        low = value >= F.lit(self.low).try_cast("double") if self.low is not None else F.lit(True)
        high = value <= F.lit(self.high).try_cast("double") if self.high is not None else F.lit(True)
        return F.coalesce(low & high, F.lit(False))


@dataclass(frozen=True)
class Fuzzy(Condition):
    """One token within at most two edits, a swap of neighbours being one edit."""

    word: str
    edits: int | None = None
    field: str | None = None
    boost: float = 1.0

    def __post_init__(self) -> None:
        if self.edits is not None and not 0 <= self.edits <= 2:
            raise ValueError("a word is searched within 0, 1 or 2 edits")

    def in_field(self, field: Field) -> Column:
        return field.meets(self)

    def wanted(self, field: Field) -> str:
        return self.word if field.analyzer == "exact" else self.word.lower()

    def word_test(self, field: Field) -> Callable[[Column], Column]:
        word = self.wanted(field)
        limit = default_edits(word) if self.edits is None else self.edits
        return lambda t: within_edits(t, word, limit)


def default_edits(word: str) -> int:
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


def swapped(word: str) -> list[str]:
    """The word with one pair of neighbours swapped, for each pair."""
    pairs = range(len(word) - 1)
    out = [word[:i] + word[i + 1] + word[i] + word[i + 2:] for i in pairs]
    return [w for w in dict.fromkeys(out) if w != word]


def within_edits(token: Column, word: str, limit: int) -> Column:
    if limit == 0:
        return token == word

    def close(other: str, k: int) -> Column:
        return F.levenshtein(token, F.lit(other), k) >= 0

    once = swapped(word)
    if limit == 1:
        near = close(word, 1) | token.isin(once)
    else:
        twice = sorted({w for o in once for w in swapped(o)})
        near = close(word, limit) | any_of(close(o, limit - 1) for o in once) | token.isin(twice)
    return F.length(token).between(len(word) - limit, len(word) + limit) & near


@dataclass(frozen=True)
class Everything(Condition):
    def test(self, fields: Sequence[Field]) -> Column:
        return F.lit(True)

    def leaves(self) -> list[Condition]:
        return []


class All(Condition):
    def __init__(self, *parts: Condition) -> None:
        self.parts = parts
        self.optional = any(p.optional for p in parts)

    def test(self, fields: Sequence[Field]) -> Column:
        return all_of(p.test(fields) for p in self.parts)

    def leaves(self) -> list[Condition]:
        return [leaf for p in self.parts for leaf in p.leaves()]

    def number_columns(self) -> list[str]:
        return [c for p in self.parts for c in p.number_columns()]


class AnyOf(All):
    def __init__(self, *parts: Condition) -> None:
        super().__init__(*parts)
        self.optional = True

    def test(self, fields: Sequence[Field]) -> Column:
        return any_of(p.test(fields) for p in self.parts)


class Not(Condition):
    def __init__(self, part: Condition) -> None:
        self.part = part

    def test(self, fields: Sequence[Field]) -> Column:
        return ~self.part.test(fields)

    def leaves(self) -> list[Condition]:
        return []

    def number_columns(self) -> list[str]:
        return self.part.number_columns()


def all_terms(query: str | None) -> Condition:
    """Plain words, all required; no words match everything."""
    words = (query or "").split()
    return All(*[Term(w) for w in words]) if words else Everything()


def matched_forms(condition: Condition, field: Field, limit: int) -> Column:
    """Distinct tokens of the field as written that the condition hit, in order of first use."""
    leaves = [leaf for leaf in condition.leaves() if leaf.among([field])]
    patterns = [_form_pattern(leaf, field) for leaf in leaves]
    if field.analyzer == "code" and all(p is not None for p in patterns):
        pattern = "|".join(p for p in patterns if p)
        forms = F.regexp_extract_all(field.text, F.lit(f"(?i){pattern}"), F.lit(0)) if pattern else literals([])
    else:
        tests = [t for leaf in leaves for t in [_form_test(leaf, field)] if t is not None]
        if not tests:
            return literals([])
        forms = F.filter(surface_tokens(field.name, field.analyzer), lambda t: any_of(test(t) for test in tests))
    return F.slice(F.array_distinct(forms), 1, limit)


def _form_pattern(leaf: Condition, field: Field) -> str | None:
    """Pattern of whole code tokens that a part hits; empty if there are none, None if it has no pattern."""
    if isinstance(leaf, (Term, Phrase)):
        return "|".join(rf"{t}(?!\w)(?<!\w{t})" for t in field.analyze(leaf.words))
    if isinstance(leaf, Wildcard):
        if not re.fullmatch(r"[A-Za-z0-9_?*]+", leaf.pattern):
            return ""
        body = leaf.pattern.replace("?", r"\w").replace("*", r"\w*")
        return rf"(?<!\w){body}(?!\w)"
    return None


def _form_test(leaf: Condition, field: Field) -> Callable[[Column], Column] | None:
    if field not in leaf.among([field]):
        return None
    if isinstance(leaf, (Term, Phrase)):
        wanted = field.analyze(leaf.words)
        return (lambda t: F.lower(t).isin(wanted)) if wanted else None
    if isinstance(leaf, Wildcard):
        return lambda t: F.lower(t).rlike(rf"\A(?:{wildcard_body(leaf.pattern)})\z")
    if isinstance(leaf, Regex):
        return lambda t: F.lower(t).rlike(rf"\A(?:{leaf.pattern})\z")
    if isinstance(leaf, TermRange):
        return lambda t: all_of(
            ([F.lower(t) >= leaf.low.lower()] if leaf.low is not None else [])
            + ([F.lower(t) <= leaf.high.lower()] if leaf.high is not None else [])
        )
    if isinstance(leaf, Fuzzy):
        limit = default_edits(leaf.word) if leaf.edits is None else leaf.edits
        return lambda t: within_edits(F.lower(t), leaf.word.lower(), limit)
    return None

