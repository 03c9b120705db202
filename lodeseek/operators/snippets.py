"""Line snippets of matched files.

Everything happens on the array of lines inside one row: no shuffle, no exploded text. A text
is at most ``max_file_size`` bytes, so a row stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.columns import let, literals
from lodeseek.functions.text import lines

ELLIPSIS = -1


def line_matches(lines_: Column, forms: Column) -> Column:
    """For each line, whether it contains one of the forms as written."""
    return F.transform(lines_, lambda line: F.exists(forms, lambda f: F.contains(line, f)))


def _shift(flags: Column, by: int, size: Column) -> Column:
    """``result[i] = flags[i + by]``, false beyond the ends."""
    if by == 0:
        return flags
    room = F.greatest(size - abs(by), F.lit(0))
    pad = F.array_repeat(F.lit(False), F.least(size, F.lit(abs(by))))
    if by > 0:
        return F.concat(F.slice(flags, by + 1, room), pad)
    return F.concat(pad, F.slice(flags, 1, room))


def _shown(found: Column, lines_: Column, context: int) -> Column:
    """Lines near a match, with a blank line where something is left out between matches."""

    def build(flags: Column, size: Column) -> Column:
        near = F.arrays_zip(*[_shift(flags, d, size).alias(f"m{d + context}") for d in range(-context, context + 1)])
        rows = F.arrays_zip(
            lines_.alias("line"),
            F.transform(near, lambda n: _any_field(n, 2 * context + 1)).alias("inside"),
            _shift(flags, context + 1, size).alias("ahead"),
            F.sequence(F.lit(1), size).alias("no"),
            F.array_repeat(F.array_position(flags, True), size).alias("first"),
        )
        gap = lambda r: ~r["inside"] & r["ahead"] & (r["first"] < r["no"])
        kept = F.filter(rows, lambda r: r["inside"] | gap(r))
        return F.transform(kept, lambda r: F.struct(
            F.when(r["inside"], r["no"]).otherwise(ELLIPSIS).cast("int").alias("line_no"),
            F.when(r["inside"], r["line"]).otherwise("").alias("line"),
        ))

    return let(found, lambda flags: let(F.size(flags), lambda size: build(flags, size)))


def _any_field(row: Column, count: int) -> Column:
    out = row["m0"]
    for k in range(1, count):
        out = out | row[f"m{k}"]
    return out


def snippet(contents: Column | str, forms: Column, context: int = 1, preview: int = 10, limit: int = 50) -> Column:
    """Struct of ``is_preview``, ``shown`` (line_no, line) and ``excess``.

    Without a matching line the first ``preview`` lines are shown.
    """

    def of_lines(all_lines: Column, wanted: Column) -> Column:
        def with_matches(rows: Column) -> Column:
            return F.struct(
                F.lit(False).alias("is_preview"), F.slice(rows, 1, limit).alias("shown"),
                F.greatest(F.size(rows) - limit, F.lit(0)).alias("excess"),
            )

        first = F.transform(F.slice(all_lines, 1, preview), lambda line, i: F.struct(
            (i + 1).cast("int").alias("line_no"), line.alias("line"),
        ))
        as_preview = F.struct(
            F.lit(True).alias("is_preview"), first.alias("shown"),
            F.greatest(F.size(all_lines) - preview, F.lit(0)).alias("excess"),
        )
        return let(line_matches(all_lines, wanted), lambda found: F.when(
            F.array_contains(found, True), let(_shown(found, all_lines, context), with_matches)
        ).otherwise(as_preview))

    return let(lines(contents), lambda ls: let(forms, lambda fs: of_lines(ls, fs)))


def joined_lines(shown: Column) -> Column:
    """The shown lines, each ended by a line feed."""
    return F.concat(F.array_join(F.transform(shown, lambda r: F.concat(r["line"], F.lit("\n"))), ""))


def joined_numbers(shown: Column) -> Column:
    """Line numbers right-aligned to the widest one; blank for left-out lines."""
    numbers = F.transform(shown, lambda r: F.when(r["line_no"] == ELLIPSIS, "").otherwise(r["line_no"].cast("string")))
    return let(numbers, lambda ns: let(
        F.array_max(F.transform(ns, lambda n: F.length(n))),
        lambda width: F.array_join(F.transform(ns, lambda n: F.concat(F.lpad(n, width, F.lit(" ")), F.lit("\n"))), ""),
    ))


def with_snippets(files: DataFrame, forms: Column | None, context: int = 1, preview: int = 10, limit: int = 50) -> DataFrame:
    """Adds the snippet columns to files and takes the contents away."""
    forms = literals([]) if forms is None else forms
    df = files.withColumn("_snippet", snippet("contents", forms, context, preview, limit))
    shown = F.col("_snippet.shown")
    return df.select(
        *[c for c in files.columns if c != "contents"],
        joined_lines(shown).alias("source_lines"), joined_numbers(shown).alias("source_line_nums"),
        F.col("_snippet.is_preview").alias("is_preview"), F.size(shown).alias("shown_lines"),
        F.col("_snippet.excess").alias("excess_lines"),
    )


def snippet_rows(files: DataFrame, forms: Column | None, context: int = 1, preview: int = 10, limit: int = 50) -> DataFrame:
    """One row per shown line."""
    forms = literals([]) if forms is None else forms
    df = files.select("doc_id", snippet("contents", forms, context, preview, limit).alias("s"))
    return df.select("doc_id", "s.is_preview", "s.excess", F.posexplode("s.shown").alias("pos", "row")).select(
        "doc_id", "is_preview", "excess", "pos", "row.line_no", "row.line"
    )
