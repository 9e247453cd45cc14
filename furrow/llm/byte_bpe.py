"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file (lines of a base64 piece and its rank) and the splitting pattern are parameters; the
library is given both and no special tokens, once in each Python worker. Long texts are cut at safe
boundaries first, places where the pattern always ends one match and begins another: before a blank
that follows a character which isn't one, and between an ASCII letter and an ASCII digit or sign. The
pieces' ids laid end to end are the ids of the whole text. A run without such a boundary for
``LONG`` characters more (blanks, signs, letters of a script without blanks) is split by the pattern itself and
its matches are encoded one by one, as the library's own splitter may run out of stack there.

Decoding lays the bytes of the pieces side by side, so ids cut anywhere decode without loss.

Defined results: a null or empty text has no ids; special strings in a text are ordinary text; rows that
repeat an id are each encoded; an empty table gives an empty result; a null list of ids decodes to null, an id
that the rank file doesn't have is an error; null ids of documents are kept; only the named columns are read, so
other columns can have any name.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters from which a text is cut before it is encoded.
LONG = 1 << 16
#: Bytes of text that one output batch stands for.
GROUP_BYTES = 4 << 20
SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[!-@\[-`{-~])")


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, long: int = LONG):
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.long = regex.compile(pattern), long

    def pieces(self, text: str) -> Iterator[str]:
        """The text cut at safe boundaries, each piece as short as ``long`` characters allow."""
        at = 0
        while len(text) - at > self.long:
            found = SAFE.search(text, at + self.long)
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        parts = [self._encode(p) for p in self.pieces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def _encode(self, piece: str) -> np.ndarray:
        if len(piece) <= 2 * self.long:
            return self.encoding.encode_to_numpy(piece, disallowed_special=())
        ids: list[int] = []
        for match in self.pattern.finditer(piece):
            ids += self.encoding._encode_single_piece(match.group().encode())
        return np.array(ids, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


@lru_cache(maxsize=2)
def coder(file: str, pattern: str, long: int = LONG) -> Coder:
    with open(file if os.path.exists(file) else SparkFiles.get(os.path.basename(file)), "rb") as f:
        return Coder({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f) if piece}, pattern, long)


def _groups(sizes: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows of about ``GROUP_BYTES`` each."""
    cuts = np.flatnonzero(np.diff(np.cumsum(np.asarray(sizes), dtype=np.int64) // GROUP_BYTES)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])) if len(sizes) else []


def encode(docs: DataFrame, file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """One row per document: id, ids. ``file`` is the rank file's path on every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(file, pattern, long)
        for b in batches:
            texts = b.column(1)
            for x, y in _groups(pc.binary_length(texts)):
                ids = [own.encode(t.as_py()) for t in texts.slice(x, y - x)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids).view(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), lists], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    return docs.select(F.col(id_col).alias("id"), text).mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, file: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per list of ids: id, ids, decoded (the raw bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(file, pattern)
        for b in batches:
            lists = b.column(1)
            for x, y in _groups(pc.fill_null(pc.list_value_length(lists), 0)):
                part = lists.slice(x, y - x)
                decoded = [own.decode(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else None for v in part]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), part, pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    done = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")
    return done.select(F.col("id").alias(id_col), "ids", "decoded")
