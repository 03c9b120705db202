"""Searching from stored token rows instead of texts.

Four tables, appended to when documents are added and never rewritten:

- ``occurrences``: one row for each word of a field of a document, with its positions and the field's length. The
  document is named by the 20 bytes of its id's SHA-1, the digest that tells blobs and commits apart.
- ``words``: signed numbers of documents by field and word. Added documents count up, removed ones down, so
  the sum over all rows is the document frequency of now.
- ``rotations``: every rotation of a distinct word behind an end mark, so that a pattern with stars becomes one
  range of rows, and a row is the word itself; words beyond ``LONG`` characters have one row and are tested one by one.
- ``deletions``: the first characters of every distinct word, by the strings that are left when up to two of them
  are deleted. Two words within two edits share such a string, so of a field's words only those that begin like that
  are measured. Words that begin alike share these rows, so the table does not grow with the words.

Values of ``exact`` fields, such as hashes, are as many as documents and have neither rotations nor deletions, which
would be some forty rows each: the start of a pattern is a range of ``words``, everything else is tested on them.

Rows of removed documents stay in ``occurrences`` and find nothing, as hits are joined with the documents; a
document that comes back has the same rows again, which count once. Every file is sorted by what it is read
by, so Parquet's statistics skip all its other pages. A file of ``occurrences`` holds all words of a range of
documents, one of ``words`` some words of the whole range, one of ``rotations`` all rotations of some words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.columns import all_of, any_of, let
from lodeseek.functions.text import tokens
from lodeseek.operators.match import (
    AnyOf, All, Condition, Everything, Field, Fuzzy, Not, NumberRange, Phrase, Term, TermRange, Wildcard, default_edits,
)
from lodeseek.schemas import APPENDED
from lodeseek.session import write_sorted

LONG = 64  # characters of a word that is rotated
HEAD, EDITS = 6, 2  # first characters of a word that deletions are made from, and how many go
MANY = 1000  # expanded words that are named in a filter; more are joined
SEEDS = 1_000_000  # documents of the rarest word that are broadcast; more are joined by a shuffle
END = "\0"

Part = tuple[DataFrame, Sequence[Field]]


@dataclass(frozen=True)
class TokenIndex:
    """The four tables."""

    occurrences: DataFrame
    words: DataFrame
    rotations: DataFrame
    deletions: DataFrame

    def vocabulary(self) -> DataFrame:
        """(field, term, df) of now."""
        return self.words.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")


def key_of(doc_id: Column | str = "doc_id") -> Column:
    """What stands for a document in token rows."""
    return F.unhex(F.sha1(doc_id))


def _groups(rows: Column, key: Callable[[Column], Column], group: Callable[[Column, Column], Column]) -> Column:
    """``group(key, rows)`` of each run of equal keys in an array."""
    def runs(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda e, i: F.when((i == 0) | (key(F.get(s, i - 1)) != key(e)), i)))
        return let(starts, lambda b: F.transform(b, lambda start, k: group(key(F.get(s, start)), F.transform(
            F.sequence(start, F.coalesce(F.get(b, k + 1), F.size(s)) - 1), lambda j: F.get(s, j)))))

    return let(rows, runs)


def grouped_words(words: Column) -> Column:
    """(term, positions) of the distinct words of an array, inside the row."""
    rows = F.array_sort(F.transform(words, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    return _groups(rows, lambda e: e["term"], lambda term, run: F.struct(term.alias("term"), run["pos"].alias("positions")))


def token_rows(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """(field, term, doc, positions, length) of every distinct word of a document's fields."""
    # One shuffle, of texts: they take less room than their words with positions. A part is a range of documents, so
    # a frequent word is spread out. Rows of one document id meet there, also if it was given with several texts.
    # Long texts go apart; a document's short ones are one row, which names it once.
    groups = [g for g in ([f for f in fields if f.analyzer == "code"], [f for f in fields if f.analyzer != "code"]) if g]
    none = F.lit(None).cast("string")
    texts = reduce(DataFrame.unionByName, [
        df.filter(any_of(F.col(f.name) != "" for f in g)).select(
            F.lit(" ".join(f.name for f in g)).alias("fields"), key_of().alias("doc"),
            *[(F.col(f.name) if f in g else none).alias(f"text{k}") for k, f in enumerate(fields)])
        for g in groups])
    part = ["fields", "doc"] if len(groups) > 1 else ["doc"]
    dealt = texts.repartitionByRange(*part)
    cut = F.array(*[F.struct(F.lit(f.name).alias("field"), tokens(f"text{k}", f.analyzer).alias("t")) for k, f in enumerate(fields)])
    rows = dealt.select(*part, F.inline(cut))
    words = rows.select(*part, "field", F.size("t").alias("length"), F.explode(grouped_words(F.col("t"))).alias("w"))
    order = ["field", "term", "doc"]
    grouped = words.select(*part, "field", "w.term", "w.positions", "length").groupBy(*order, *part[:-1]).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"), F.max("length").alias("length"))
    return grouped.select(*order, "positions", "length").sortWithinPartitions(*order)


def rotation_rows(words: DataFrame) -> DataFrame:
    """(field, rotated, term, long) of distinct (field, term)."""
    marked = F.concat("term", F.lit(END))
    turn = lambda i: F.concat(F.substr(marked, i), F.substr(marked, F.lit(1), i - 1))
    # A word that has the end mark itself could not be told from its rotations.
    long = (F.char_length("term") > LONG) | F.contains("term", F.lit(END))
    turns = F.when(long, F.array(F.col("term"))).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(marked)), turn))
    rows = words.select("field", long.alias("long"), F.explode(turns).alias("rotated"))
    # Each file holds the whole range of some words: rotations are not shuffled, which would be many times the words.
    return rows.sortWithinPartitions("field", "rotated").select("field", "rotated", turned_back().alias("term"), "long")


def turned_back() -> Column:
    """The word of a row of ``rotations``."""
    return F.when(F.col("long"), F.col("rotated")).otherwise(
        F.concat(F.substring_index("rotated", END, -1), F.substring_index("rotated", END, 1)))


def _head(term: str) -> Column:
    """The first characters of a word, which deletions are made from."""
    return F.left(F.col(term), F.lit(HEAD))


def _one_less(text: Column) -> Column:
    """The text without one character, for each of its characters."""
    return F.when(F.char_length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.char_length(text)), lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1))))


def _deletions_behind(head: Column, gone: int) -> Column:
    """What is left of a head whose first ``gone`` characters are deleted and whose next one stays."""
    rest = [F.array(F.substr(head, F.lit(gone + 2)))]
    for _ in range(EDITS - gone):
        rest.append(F.flatten(F.transform(rest[-1], _one_less)))
    return F.transform(F.concat(*rest), lambda r: F.concat(F.substr(head, F.lit(gone + 1), F.lit(1)), r))


def deletion_rows(words: DataFrame) -> DataFrame:
    """(field, left, term) of distinct (field, term)."""
    head = _head("term")
    # What is left begins with one of the first characters. Words are dealt out by these and become many rows behind the shuffle.
    firsts = [F.substr(head, F.lit(gone + 1), F.lit(1)) for gone in range(EDITS + 1)]
    dealt = words.select("field", "term", F.explode(F.array_distinct(F.array(*firsts))).alias("lead")).repartitionByRange("field", "lead", "term")
    none = F.array().cast("array<string>")
    left = [F.when(first == F.col("lead"), _deletions_behind(head, gone)).otherwise(none) for gone, first in enumerate(firsts)]
    rows = dealt.select("field", F.explode(F.array_distinct(F.concat(*left))).alias("left"), "term")
    return rows.sortWithinPartitions("field", "left", "term")  # words of one string begin alike


def deletions_of(word: str) -> list[str]:
    found = {word[:HEAD]}
    for _ in range(EDITS):
        found |= {w[:i] + w[i + 1:] for w in found for i in range(len(w))}
    return sorted(found)


def append_rows(put: Callable[..., DataFrame], added: Sequence[Part], removed: Sequence[Part] = ()) -> None:
    """Writes what documents that come and go add to the tables.

    ``put(name, *parts)`` writes the parts of a table one after the other and returns it as written.
    """
    written = put("occurrences", *[token_rows(df, fields) for df, fields in added])
    signed = written.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    for df, fields in removed:
        for f in fields:
            lost = df.select(F.lit(f.name).alias("field"), F.explode(F.array_distinct(f.tokens)).alias("term"))
            signed = signed.unionByName(lost.groupBy("field", "term").agg((-F.count(F.lit(1))).alias("df")))
    summed = signed.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
    # Words stay where they were summed: a file holds the whole range of some words, as one of rotations does.
    words = put("words", summed.sortWithinPartitions("field", "term"))
    # A word that is no more frequent than before was there before.
    exact = sorted({f.name for _, fields in [*added, *removed] for f in fields if f.analyzer == "exact"})
    more = words.filter(F.col("df") > 0).filter(~F.col("field").isin(exact))
    # They lie in few files, so they are dealt out before each becomes many rows.
    put("rotations", rotation_rows(more.repartition("field", "term")))
    # Words that begin alike have the same deletions, which are stored once.
    put("deletions", deletion_rows(more.select("field", _head("term").alias("term")).distinct()))


def write_index(folder: str, parts: Sequence[Part]) -> TokenIndex:
    """Token tables of some documents in a new folder."""
    spark = parts[0][0].sparkSession

    def put(name: str, *dfs: DataFrame) -> DataFrame:
        return write_sorted(f"{folder}/{name}", APPENDED[name], *dfs)

    append_rows(put, parts)
    return TokenIndex(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in APPENDED.items()})


# Distinct words that a part of a condition stands for


def turned(pattern: str) -> str:
    """The start of a rotation that every word of a pattern has; empty if the pattern has no character of its own."""
    parts = re.split(r"[?*]+", pattern)
    if len(parts) == 1:
        return pattern + END
    return parts[-1] + END + parts[0] if parts[0] or parts[-1] else max(parts, key=len)


def expanded(index: TokenIndex, leaf: Condition, f: Field) -> DataFrame:
    """(term) of a field that a wildcard, range, pattern or fuzzy word stands for."""
    test = leaf.word_test(f)
    here = F.col("field") == f.name
    if test is None:
        return index.words.filter(F.lit(False)).select("term")
    words = index.words.filter(here)
    if isinstance(leaf, Wildcard) and f.analyzer == "exact":
        words = words.filter(F.col("term").startswith(re.split(r"[?*]", leaf.pattern.lower())[0]))
    elif isinstance(leaf, Wildcard):
        start = turned(leaf.pattern.lower())
        if start:
            rows = index.rotations.filter(here).withColumn("term", turned_back())
            words = rows.filter(~F.col("long") & F.col("rotated").startswith(start)).unionByName(rows.filter("long"))
    elif isinstance(leaf, Fuzzy):
        word = leaf.wanted(f)
        limit = default_edits(word) if leaf.edits is None else leaf.edits
        if not limit:
            words = words.filter(F.col("term") == word)
        elif f.analyzer != "exact":
            heads = index.deletions.filter(here & F.col("left").isin(deletions_of(word))).select(_head("term").alias("head"))
            words = words.join(heads.distinct(), _head("term") == F.col("head"), "left_semi")
    elif isinstance(leaf, TermRange):  # once more, as the bounds that are pushed down
        for bound, beyond in ((leaf.low, F.col("term") >= (leaf.low or "").lower()), (leaf.high, F.col("term") <= (leaf.high or "").lower())):
            words = words if bound is None else words.filter(beyond)
    return words.select("term").distinct().filter(test(F.col("term")))


# What a document holds of the words asked for


@dataclass(frozen=True)
class StoredField(Field):
    """A field that answers from the evidence columns of a row."""

    at: dict[str, str] = field(default_factory=dict, compare=False)  # word -> column of its positions
    flags: dict[str, str] = field(default_factory=dict, compare=False)  # part of a condition -> column
    size: str = field(default="", compare=False)

    def _at(self, token: str) -> Column:
        return F.col(self.at[token])

    def has(self, token: str) -> Column:
        return self._at(token).isNotNull()

    def count(self, token: str) -> Column:
        return F.coalesce(F.size(self._at(token)), F.lit(0)) if self.analyzer != "exact" else self.has(token).cast("int")

    def length(self) -> Column:
        return F.col(self.size)

    def count_run(self, run: Sequence[str]) -> Column:
        if len(run) == 1:
            return self.count(run[0])
        starts = [_moved(self._at(t), k) for k, t in enumerate(run)]
        return F.coalesce(F.size(reduce(F.array_intersect, starts)), F.lit(0))

    def has_run(self, run: Sequence[str]) -> Column:
        return all_of(self.has(t) for t in dict.fromkeys(run)) & (self.count_run(run) > 0)

    def has_near(self, run: Sequence[str], slop: int) -> Column:
        return F.when(all_of(self.has(t) for t in dict.fromkeys(run)), near({t: self._at(t) for t in run}, run, slop)).otherwise(False)

    def meets(self, leaf: Condition) -> Column:
        return F.coalesce(F.col(self.flags[repr(leaf)]), F.lit(False))


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _before(positions: Column, limit: Column) -> Column:
    return F.filter(positions, lambda x: x < limit)


def near(at: dict[str, Column], run: Sequence[str], slop: int) -> Column:
    """Some choice of distinct positions with max(pos - slot) - min(pos - slot) <= slop.

    One sweep over the positions of all slots by pos - slot. Each slot keeps the last positions it met,
    as many as it has slots of its word; the latest choice is the narrowest. Slots of one word take rising
    positions, which never makes a choice wider.
    """
    event = lambda k: lambda p: F.struct((p - k).alias("shifted"), F.lit(k).alias("slot"), p.alias("pos"))
    events = F.array_sort(F.concat(*[F.transform(at[t], event(k)) for k, t in enumerate(run)]))
    keep = [run.count(t) for t in run]
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(False).alias("found"), *[none.alias(f"h{k}") for k in range(len(run))])

    def fits(held: Column, high: Column) -> Column:
        tests = []
        for word in dict.fromkeys(run):
            later: Column | None = None
            for slot in [k for k, t in enumerate(run) if t == word][::-1]:
                seen = held[f"h{slot}"]
                best = F.array_max(seen) if later is None else F.array_max(_before(seen, later))
                tests.append(F.coalesce(best >= high - slop + slot, F.lit(False)))
                later = best
        return all_of(tests)

    def step(state: Column, e: Column) -> Column:
        def kept(k: int) -> Column:
            more = F.concat(state[f"h{k}"], F.array(e["pos"]))
            last = F.slice(more, F.greatest(F.size(more) - (keep[k] - 1), F.lit(1)), keep[k])
            return F.when(e["slot"] == k, last).otherwise(state[f"h{k}"]).alias(f"h{k}")

        held = F.struct(*[kept(k) for k in range(len(run))])
        return let(held, lambda h: F.struct((state["found"] | fits(h, e["shifted"])).alias("found"), *[h[f"h{k}"].alias(f"h{k}") for k in range(len(run))]))

    return F.aggregate(events, start, step, lambda s: s["found"])


def parts_of(condition: Condition) -> list[Condition]:
    """All parts that look at words, also those that are denied."""
    if isinstance(condition, All):
        return [leaf for p in condition.parts for leaf in parts_of(p)]
    if isinstance(condition, Not):
        return parts_of(condition.part)
    return [] if isinstance(condition, (Everything, NumberRange)) else [condition]


def without_words(condition: Condition) -> bool:
    """Whether a document may match that has none of the words."""
    if isinstance(condition, AnyOf):
        return any(without_words(p) for p in condition.parts)
    if isinstance(condition, All):
        return all(without_words(p) for p in condition.parts)
    return isinstance(condition, (Everything, NumberRange, Not))


def needed(condition: Condition) -> list[Condition]:
    """Terms and phrases that every match has in some field."""
    if isinstance(condition, All) and not isinstance(condition, AnyOf):
        return [leaf for p in condition.parts for leaf in needed(p)]
    return [condition] if isinstance(condition, (Term, Phrase)) else []


def _named(pairs: Sequence[tuple[str, str]]) -> Column:
    return any_of((F.col("field") == f) & (F.col("term") == t) for f, t in pairs)


def _seeds(index: TokenIndex, condition: Condition, fields: Sequence[Field]) -> DataFrame | None:
    """Documents that hold the rarest of the words that every match has."""
    choices = []
    for leaf in needed(condition):
        wanted = [(f.name, f.analyze(leaf.words)) for f in leaf.among(fields)]
        choices.append([(name, words) for name, words in wanted if words])
    pairs = {(name, t) for choice in choices for name, words in choice for t in words}
    if not pairs:
        return None
    # At most one row for each word of the request.
    rows = index.words.filter(_named(sorted(pairs))).groupBy("field", "term").agg(F.sum("df").alias("df")).collect()
    df = {(r["field"], r["term"]): r["df"] for r in rows}
    rarest = [[min((df.get((name, t), 0), name, t) for t in words) for name, words in choice] for choice in choices if choice]
    best = min(rarest, key=lambda found: sum(n for n, _, _ in found))
    seeds = index.occurrences.filter(_named([(name, t) for _, name, t in best])).select("doc").distinct()
    return F.broadcast(seeds) if sum(n for n, _, _ in best) <= SEEDS else seeds


def with_evidence(docs: DataFrame, index: TokenIndex, condition: Condition, fields: Sequence[Field]) -> tuple[DataFrame, list[Field]]:
    """``docs`` that may match, with what they hold of the words asked for, and fields that answer from it.

    Reads the rows of the words asked for only, and of those, where all matches need some word, the rows of
    documents that have the rarest one. Looks up the words' frequencies and, up to ``MANY``, the words that
    patterns stand for, when it is called.
    """
    leaves = parts_of(condition)
    pairs = list(dict.fromkeys(
        (f.name, t) for leaf in leaves if isinstance(leaf, (Term, Phrase)) for f in leaf.among(fields) for t in f.analyze(leaf.words)))
    parts = list(dict.fromkeys((f, leaf) for leaf in leaves if not isinstance(leaf, (Term, Phrase)) for f in leaf.among(fields)))
    at = {pair: f"at{k}" for k, pair in enumerate(pairs)}
    flag = {(f.name, repr(leaf)): f"is{k}" for k, (f, leaf) in enumerate(parts)}
    stored: list[Field] = [
        StoredField(f.name, f.analyzer, f.boost, {t: c for (name, t), c in at.items() if name == f.name},
                    {p: c for (name, p), c in flag.items() if name == f.name}, f"length{k}")
        for k, f in enumerate(fields)]
    if not pairs and not parts:
        return docs, stored

    blank = {"positions": F.lit(None).cast("array<int>"), "length": F.lit(None).cast("int")}
    rows = []
    if pairs:
        rows.append(index.occurrences.filter(_named(pairs)).withColumn("part", F.lit(-1)))
    if parts:
        stands = reduce(DataFrame.unionByName, [
            expanded(index, leaf, f).select(F.lit(f.name).alias("field"), "term", F.lit(k).alias("part"))
            for k, (f, leaf) in enumerate(parts)])
        few = stands.limit(MANY + 1).toArrow()  # an Arrow table goes back as a local relation, without Python rows
        found = index.occurrences.select("field", "term", "doc")
        if few.num_rows <= MANY:
            stands = docs.sparkSession.createDataFrame(few, stands.schema)
            named = few.to_pylist()
            found = found.filter(any_of(
                (F.col("field") == name) & F.col("term").isin(sorted({r["term"] for r in named if r["field"] == name}))
                for name in sorted({r["field"] for r in named})))
            stands = F.broadcast(stands)  # MANY rows at most
        rows.append(found.join(stands, ["field", "term"]).withColumns(blank).select(*APPENDED["occurrences"].names, "part"))
    evidence = reduce(DataFrame.unionByName, rows)
    seeds = _seeds(index, condition, fields)
    if seeds is not None:
        evidence = evidence.join(seeds, "doc", "left_semi")
    holds = evidence.groupBy("doc").agg(
        *[F.max(F.when((F.col("part") < 0) & _named([pair]), F.col("positions"))).alias(c) for pair, c in at.items()],
        *[F.max(F.when(F.col("part") == k, F.lit(True))).alias(flag[f.name, repr(leaf)]) for k, (f, leaf) in enumerate(parts)],
        *[F.max(F.when(F.col("field") == f.name, F.col("length"))).alias(f"length{k}") for k, f in enumerate(fields)])
    found = docs.withColumn("doc", key_of()).join(holds, "doc", "left" if without_words(condition) else "inner")
    return found.drop("doc"), stored
