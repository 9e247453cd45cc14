"""Token ids as Parquet list columns that can be read selectively.

Documents are range-partitioned by id and sorted, encoded in their partition, and written in that order:
the token column with dictionary encoding, the metadata columns delta-encoded, with small row groups and
pages and with page indexes, so that a reader can fetch the metadata alone or the ids of a few
documents. What an operator returns is read back from the files.

Texts are cut before each blank; the tokenizer's own word pattern never matches across such a place, so the
ids are those of the whole text. The library encodes each distinct piece once per worker and the ids are
remembered in a table of bounded size. Texts with blanks side by side, other rare white space or a special
string are encoded whole.

Defined results: a null or empty text has the end id only; ids are ordered ascending, nulls first; rows
that repeat an id are ordered by a hash of their texts, so that many of them spread over partitions; an
empty table gives no rows; a long text is one row, encoded in a call of its own. Other columns aren't read,
so their names can't clash.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder

END = 0
REMEMBERED = 800_000
#: A piece of letters and then neither letters nor digits nor white space: the word pattern takes the two parts apart.
WORD = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([^\w\s]*)")
#: Where a text can't be cut at each blank: white space other than these four, two blanks side by side, a blank at the end.
UNCUT = r"[\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | $"
#: Bytes of text that are encoded at once.
GROUP_BYTES = 4 << 20
WRITE = {
    "compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.writer.version": "v2", "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10),
    "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": str(1 << 20),
}


class Encoder:
    """Ids of whole texts as unsigned 32-bit integers."""

    def __init__(self, file: str, remembered: int = REMEMBERED, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.remembered = Tokenizer.from_file(file), remembered
        specials = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.uncut = "|".join([UNCUT, *specials])
        # how the byte-level vocabulary writes bytes: printable ones as themselves, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.letters = {k: k if k in plain else next(others) for k in range(256)}
        self.blank = chr(self.letters[32])
        self.end = np.array([end], "<u4").tobytes()
        self.known: dict[str, bytes] = {}  # piece behind a blank -> ids
        self.signs: dict[str, bytes] = {}  # what follows a word's letters -> ids

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """The ids of one word of the word pattern, by the library's model alone."""
        written = word.replace(" ", self.blank) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.library.model.tokenize(written)]).tobytes()

    def _ids(self, pieces: list[str], before: str, known: dict[str, bytes]) -> list[bytes]:
        """The ids of each piece behind ``before``, looked up in ``known`` and added to it."""
        if len(known) > self.remembered:
            known.clear()
        if len(self.signs) > self.remembered:
            self.signs.clear()
        found = list(map(known.get, pieces))
        other, signs = [], self.signs
        for k in [k for k, ids in enumerate(found) if ids is None]:
            if m := WORD.fullmatch(pieces[k]):
                a, b = m.groups()
                if (ids := known.get(a)) is None:
                    known[a] = ids = self._word(before + a)
                if b:
                    if b not in signs:
                        signs[b] = self._encode([b])[0]
                    ids += signs[b]
                    if len(b) == 1:
                        known[pieces[k]] = ids
                found[k] = ids
            else:
                other.append(k)
        for k, ids in zip(other, self._encode([before + pieces[k] for k in other])):
            known[pieces[k]] = found[k] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, the end id behind each; how many each has).

        A text is cut before each blank, the distinct pieces are encoded, and their ids laid out in order.
        """
        odd = np.asarray(pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False), bool)
        whole = texts.filter(pa.array(odd)).to_pylist()
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if len(whole) else texts, " ")
        at = np.asarray(split.offsets) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), np.array(coded.indices)
        first = at[:-1]  # the first piece of a text has no blank before it; a whole text is its only piece
        heads = [words[k] for k in index[first].tolist()]
        index[first] = len(words) + np.arange(len(texts), dtype=np.int32)
        ids = self._ids(words, " ", self.known) + self._ids(heads, "", {})
        if len(whole):
            for k, x in zip(np.flatnonzero(odd).tolist(), self._encode(whole)):
                ids[len(words) + k] = x
        ids.append(self.end)
        index = np.insert(index, at[1:], len(ids) - 1)
        laid = pa.array(ids, pa.large_binary()).take(pa.array(index))
        ends = np.frombuffer(laid.buffers()[1], np.int64)[: len(index) + 1] // 4
        return np.frombuffer(laid.buffers()[2], "<u4")[: ends[-1]], np.diff(ends[at[1:] + 1 + np.arange(len(texts))], prepend=0)


@lru_cache(maxsize=2)
def encoder(file: str, end: int = END) -> Encoder:
    return Encoder(file if os.path.exists(file) else SparkFiles.get(os.path.basename(file)), end=end)


def write_tokens(docs: DataFrame, file: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """Write (id, part, at, n_tokens, ids) in ascending id order; ``at`` counts the ids before it in its part."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = encoder(file, end), TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.cumsum(np.asarray(pc.binary_length(b.column(1))), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(sizes // GROUP_BYTES)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                ids, n = coder.encode(b.column(1).slice(x, y - x))
                ends = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends[:-1]), pa.array(n), lists], names=["id", "part", "at", "n_tokens", "ids"])
                at += int(ends[-1])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ordered = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("h")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "t")
    ordered.mapInArrow(run, f"id {kind}, part int, at bigint, n_tokens bigint, ids array<int>").write.mode("overwrite").options(**WRITE).parquet(path)


def token_index(written: DataFrame) -> DataFrame:
    """(id, start, n_tokens): where each document's ids begin; reads the metadata columns only."""
    parts = written.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    return written.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("at"))


def read_back(spark, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, start, n_tokens, ids_crc32."""
    indexed = token_index(spark.read.parquet(path)).select("id", "start", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat, at = np.asarray(lists.values).astype("<u4", copy=False), np.asarray(lists.offsets)
            crc = pa.array([zlib.crc32(flat[x:y]) for x, y in zip(at[:-1], at[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), crc], names=["id", "start", "n_tokens", "ids_crc32"])

    kind = indexed.schema["id"].dataType.simpleString()
    return indexed.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def tokenise(docs: DataFrame, file: str, *, path: str | None = None, **columns) -> DataFrame:
    """Write the files (into the shared folder unless ``path`` is given) and return what they hold."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, file, path, **columns)
    return read_back(spark, path, id_col=columns.get("id_col", "doc_id"))
