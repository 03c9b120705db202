"""Tokenizers and text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.functions.columns import let, literals, text

# Separator pattern of each analyzer.
SEPARATORS = {
    "code": "[^A-Za-z0-9_]+",
    "name": "[^A-Za-z0-9_]+",
    "email": "[^A-Za-z0-9_]+",
    "ref": "/",
    "path": r"[/\\.]",
    "message": r"[^\p{L}\p{N}_]+",
}


# The same separators as Java reads them fastest; its ``\\W`` is exactly ``[^A-Za-z0-9_]``.
_FAST = {**SEPARATORS, **dict.fromkeys(("code", "name", "email"), r"\W+")}


def surface_tokens(column: Column | str, analyzer: str) -> Column:
    """Tokens as written, in order, empties dropped."""
    return F.filter(F.split(text(column), _FAST[analyzer]), lambda t: t != "")


def tokens(column: Column | str, analyzer: str) -> Column:
    """Lower-cased tokens in order; ``exact`` keeps the whole value as the one token."""
    if analyzer == "exact":
        return F.filter(F.array(text(column)), lambda t: t != "")
    return F.transform(surface_tokens(column, analyzer), lambda t: F.lower(t))


def ref_tokens(refs: Column | str) -> Column:
    """Tokens of all refs of a document in one list."""
    refs = F.col(refs) if isinstance(refs, str) else refs
    return F.flatten(F.transform(refs, lambda r: tokens(r, "ref")))


def extension(path: Column | str) -> Column:
    """Lower-cased text after the last dot of the last path segment."""
    return F.lower(F.regexp_extract(text(path), r"\.([^./\\]*)$", 1))


def charcount(contents: Column | str) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text(contents), "UTF-16BE")) / 2).cast("int")


def _occurrences(contents: Column, part: str) -> Column:
    without = F.replace(contents, F.lit(part), F.lit(""))
    return (F.octet_length(contents) - F.octet_length(without)) / len(part)


def linecount(contents: Column | str) -> Column:
    """Number of lines; a final terminator does not start another one."""
    contents = text(contents)
    open_end = (contents != "") & ~F.right(contents, F.lit(1)).isin("\n", "\r")
    ends = _occurrences(contents, "\n") + _occurrences(contents, "\r") - _occurrences(contents, "\r\n")
    return (ends + open_end.cast("int")).cast("int")


def lines(contents: Column | str) -> Column:
    """Lines of a text without the empty ones at its end; an empty text is one empty line."""
    contents = text(contents)
    # Cutting the terminators at the end first leaves no empty last line to drop. With one kind
    # of terminator left the split needs no pattern.
    kept = F.rtrim(contents, F.lit("\r\n"))
    plain = F.replace(F.replace(kept, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when((contents != "") & (kept == ""), literals([])).otherwise(F.split(plain, "\n"))


def is_text(content: Column | str) -> Column:
    """No byte in 0-8, 14-31 or 127."""
    content = F.col(content) if isinstance(content, str) else content
    return ~F.decode(content, "ISO-8859-1").rlike(r"[\x00-\x08\x0e-\x1f\x7f]")


def decode_text(content: Column | str) -> Column:
    """Bytes to string; null when the bytes look binary."""
    content = F.col(content) if isinstance(content, str) else content
    # Malformed UTF-8 becomes U+FFFD; decode() would fail the whole job on it.
    return F.when(is_text(content), F.make_valid_utf8(content.cast("string")))


def token_string(values: Column) -> Column:
    """Tokens joined so that a run of tokens is a substring: ``\\0a\\0b\\0``."""
    return let(values, lambda v: F.concat(F.lit("\0"), F.array_join(v, "\0"), F.lit("\0")))
