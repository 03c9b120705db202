"""Byte-level BPE ids of whole texts inside tasks."""

from __future__ import annotations

import base64
import os
import re
from array import array

from pyspark import SparkFiles
from pyspark.sql import SparkSession

# Byte-level BPE cuts texts by this pattern before merging. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = "<|endoftext|>"
_PIECE = re.compile("[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
# With these, a run of white space can go on beyond an ASCII one, so the text is encoded in one.
_WIDE_SPACE = re.compile("[" + "".join(map(chr, (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
))) + "]")
# A run of white space beyond this overflows the stack of the pattern's matcher; such texts go to the other library.
LONG_RUN = 20_000
_LONG = re.compile(r"\s{%d}" % LONG_RUN)
_HELD = 300_000
_encoders: dict[str, Encoder] = {}


def sent(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary file to the executors; its name there."""
    name = os.path.basename(path)
    if name not in spark.sparkContext.listFiles and not any(
        f.endswith("/" + name) for f in spark.sparkContext.listFiles
    ):
        spark.sparkContext.addFile(path)
    return name


class Encoder(dict):
    """Little-endian 32-bit ids of a text; those of its space-led words are kept for the next text.

    White space never joins what stands before it, so the parts that start at white space are
    encoded independently.
    """

    def __init__(self, path: str, whole_path: str) -> None:
        import tiktoken

        super().__init__()
        self._whole_path, self._whole = whole_path, None
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._plain = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})

    def __missing__(self, piece: str) -> bytes:
        raw = array("I", self._plain.encode_ordinary(piece)).tobytes()
        if len(piece) <= 64:
            if len(self) >= _HELD:
                self.clear()
            self[piece] = raw
        return raw

    def _of_long_runs(self, text: str) -> bytes:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._whole_path)
        return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if len(text) > LONG_RUN and _LONG.search(text):
            return self._of_long_runs(text)
        if END_OF_TEXT in text:
            return array("I", self._plain.encode(text, allowed_special="all")).tobytes()
        if _WIDE_SPACE.search(text):
            return array("I", self._plain.encode_ordinary(text)).tobytes()
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


def encoder(name: str, whole: str) -> Encoder:
    """The encoder of two files sent by ``sent``, one for each Python worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(SparkFiles.get(name), SparkFiles.get(whole))
    return _encoders[name]
