"""Importance resampling towards a target distribution, with hashed word n-gram features.

Each distinct word of the corpus enters an Aho-Corasick dictionary, bounded by a blank on both sides,
with its CRC-32 and length as payload. A scan of a text emits the payloads of its words; the CRC of a
longer feature is composed of its neighbours' payloads (a CRC is linear, so the CRC of ``a b`` is the CRC of
``a`` and a blank, moved on by the length of ``b``, combined with the CRC of ``b``), and is never computed from
the bytes again. The CRC's remainder is the feature's bucket, for counting and for scoring.

The dictionary holds the most frequent words of at most ``WORD_BYTES`` bytes, ``DICTIONARY`` of them at most (counted over all texts of
both tables), so what is broadcast has a fixed bound; a word outside it gets its CRC from its own bytes, with the
same result. Three scans read the texts: words, bucket counts, weights. What goes between
them is a fixed number of buckets. Scores are drawn with Gumbel noise from a hash of seed and id; the
highest of them are found by a range sort and the row counts of its partitions, not in one task.

Defined results: a null text has no words; a document without features has weight 0; a null id counts as
the empty string in the hash; rows that repeat an id are documents of their own, with equal noise, and equal
scores and ids take consecutive ranks in any order; an empty table or an empty target gives rows
without ranks or counts of zero; a long text is scanned in pieces of ``PIECE`` bytes that overlap by
two words; only the named columns are read, so other columns can have any name.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_folder

BUCKETS = 10_000
RUN = 3
SEED = 42
LEAST_WORDS = 20
#: Of the documents long enough, so many in a hundred are drawn.
PERCENT = 5
#: Words of the broadcast dictionary and bytes of a word in it: 6.4 MB at most.
DICTIONARY, WORD_BYTES = 100_000, 64
PIECE = 1 << 20
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
UNIT = 1000
SCALE = 1 << 32

_PLAIN = bytes(32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _crc_table() -> np.ndarray:
    """What a zero byte makes of each value of a CRC-32's last byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _moved(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][values & 255] ^ table[1][values >> 8 & 255] ^ table[2][values >> 16 & 255] ^ table[3][values >> 24]


class CrcShift:
    """Moves CRC-32 values on by any number of bytes: tables for 0 to 63, and for 64 times each power of two."""

    def __init__(self):
        last = _crc_table()
        table = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
        tables = []
        for _ in range(64):
            tables.append(table)
            table = table >> 8 ^ last[table & 255]
        self.short, self.powers = np.stack(tables).reshape(-1), [table]

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = (n & 63) << 10
        out = self.short[at + (crc & 255)] ^ self.short[at + 256 + (crc >> 8 & 255)] ^ self.short[at + 512 + (crc >> 16 & 255)] ^ self.short[at + 768 + (crc >> 24)]
        rest, k = n >> 6, 0
        while rest.any():
            if k == len(self.powers):
                self.powers.append(_moved(self.powers[-1], self.powers[-1]))
            odd = np.flatnonzero(rest & 1)
            out[odd] = _moved(out[odd], self.powers[k])
            rest, k = rest >> 1, k + 1
        return out


def pieces(text: bytes, size: int = PIECE, carried: int = RUN - 1) -> Iterator[tuple[bytes, int]]:
    """(piece, words it repeats from the one before): a plain text cut at blanks."""
    at, before = 0, []
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        piece = b" ".join([*before, text[at:end]])
        yield piece, len(before)
        before = piece.rsplit(None, carried)[-carried:] if piece.strip() else before
        at = end
    yield b" ".join([*before, text[at:]]), len(before)


class FeatureScan:
    """Finds the buckets of all word runs of texts by one automaton."""

    def __init__(self, words: list[bytes], buckets: int = BUCKETS):
        self.buckets, self.shift = buckets, CrcShift()
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.open = np.array([zlib.crc32(w + b" ") for w in words], np.uint32)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        if words:
            self.automaton.make_automaton()

    def payloads(self, data: bytes) -> tuple[np.ndarray, ...]:
        """(starts, lengths, crc, crc with a blank behind) of the words of plain bytes that begin and end with a blank."""
        blank = np.frombuffer(data, np.uint8) == 32
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        known = np.full(len(starts), -1, np.int64)
        if len(self.crc) and len(starts):
            emitted = np.fromiter(chain.from_iterable(self.automaton.iter(data.decode("latin-1"))), np.int64)
            known[np.searchsorted(ends, emitted[::2])] = emitted[1::2]
        crc, opened = (self.crc[known], self.open[known]) if len(self.crc) else (np.zeros(len(starts), np.uint32), np.zeros(len(starts), np.uint32))
        for k in np.flatnonzero(known < 0).tolist():
            crc[k] = zlib.crc32(data[starts[k] : ends[k]])
            opened[k] = zlib.crc32(b" ", int(crc[k]))
        return starts, ends - starts, crc, opened

    def features(self, group: list[tuple[int, bytes, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row, bucket) of the runs of one, two and three words of pieces given as (row, bytes, repeated words)."""
        sizes = np.array([len(x[1]) + 1 for x in group])
        begins = np.concatenate([[1], 1 + np.cumsum(sizes)[:-1]])
        starts, n, crc, opened = self.payloads(b" " + b" ".join(x[1] for x in group) + b" ")
        piece = np.searchsorted(begins, starts, "right") - 1
        place = np.arange(len(starts)) - np.searchsorted(piece, np.arange(len(group)))[piece] if len(starts) else piece
        new = place >= np.array([x[2] for x in group])[piece]
        row = np.array([x[0] for x in group])[piece]
        out = [(row[new], crc[new])]
        two = self.shift(opened[:-1], n[1:]) ^ crc[1:]  # runs of two, by their last word
        keep = new[1:] & (place[1:] >= 1)
        out.append((row[1:][keep], two[keep]))
        three = self.shift(opened[:-2], n[1:-1] + 1 + n[2:]) ^ two[1:]
        keep = new[2:] & (place[2:] >= 2)
        out.append((row[2:][keep], three[keep]))
        return [(r, (c % np.uint32(self.buckets)).astype(np.int64)) for r, c in out]

    def groups(self, texts: list[bytes]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        """The features of texts, a group of pieces of about ``PIECE`` bytes at a time."""
        group, size = [], 0
        for row, text in enumerate(texts):
            for piece, repeated in pieces(text):
                group.append((row, piece, repeated))
                size += len(piece)
                if size >= PIECE:
                    yield self.features(group)
                    group, size = [], 0
        if group:
            yield self.features(group)


class Dictionary:
    """The broadcast words of a scan; its automaton is made once in each worker."""

    _made: dict = {}

    def __init__(self, spark: SparkSession, words: list[bytes]):
        self.words, self.name = spark.sparkContext.broadcast(words), uuid.uuid4().hex

    def scan(self, buckets: int) -> FeatureScan:
        if (key := (self.name, buckets)) not in self._made:
            self._made.clear()
            self._made[key] = FeatureScan(self.words.value, buckets)
        return self._made[key]


def _plain(column) -> list[bytes]:
    return [t.translate(_PLAIN) for t in column.to_pylist()]


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) of a table of plain texts ``t``; words over ``WORD_BYTES`` bytes are left to the scan."""

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in _plain(b.column(0)):
                for piece, _ in pieces(text, carried=0):
                    counts.update(piece.split())
                    if len(counts) > COUNTED:
                        yield emit(Counter({w: k for w, k in counts.items() if len(w) <= WORD_BYTES}))
                        counts.clear()
        yield emit(Counter({w: k for w, k in counts.items() if len(w) <= WORD_BYTES}))

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = DICTIONARY) -> list[bytes]:
    """The most frequent of the words that repeat, ``most`` at most: all whose count reaches a bound that few enough reach.

    The bound is found from a histogram over eighths of powers of two, so the driver gets that and the chosen words only.
    """
    level = F.floor(8 * F.log2("n")).cast("int")
    counts = cut(counts.where("n > 1").withColumn("level", level))
    least, total = None, 0
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # 512 rows at most
        total += r["count"]
        if total > most:
            break
        least = r.level
    return [] if least is None else [bytes(r.word) for r in counts.where(F.col("level") >= least).select("word").collect()]


def bucket_counts(texts: DataFrame, words: Dictionary, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of a table of texts ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, total = words.scan(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for group in scan.groups(_plain(b.column(0))):
                for _, bucket in group:
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def importance_gains(docs: DataFrame, target: DataFrame, words: Dictionary, *, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: how much more frequent its features are in the target, in thousandths of a natural logarithm."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for table, counts in ((docs, s), (target, t)):
        for r in bucket_counts(table.select(_text(text_col)), words, buckets).collect():  # ``buckets`` rows at most
            counts[r.bucket] = r.n
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(UNIT * math.log((int(b) + 1) * (all_s + buckets) / ((int(a) + 1) * (all_t + buckets)))) for a, b in zip(s, t)], np.int64)


def importance_weights(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per document: id, n_words, n_features, weight (the sum of its features' gains)."""
    spark = docs.sparkSession
    texts = docs.select(_text(text_col)).unionAll(target.select(_text(text_col)))
    words = Dictionary(spark, frequent_words(word_counts(texts)))
    gains = spark.sparkContext.broadcast(importance_gains(docs, target, words, text_col=text_col, buckets=buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, gain = words.scan(buckets), gains.value
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for group in scan.groups(_plain(b.column(1))):
                for k, (row, bucket) in enumerate(group):
                    many = np.bincount(row, minlength=b.num_rows)
                    n_words += many if k == 0 else 0
                    n_features += many
                    weight += np.bincount(row, weights=gain[bucket], minlength=b.num_rows).astype(np.int64)  # sums of integers far under 2^53
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), _text(text_col)).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint").withColumnRenamed("id", id_col)


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(SCALE)
    return F.floor(-UNIT * F.log(-F.log(u))).cast("long")


def ranked(scored: DataFrame, drawn: int, id_col: str) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 and so on for the ``drawn`` highest scores, ties to the smaller id.

    Rows are dealt by ranges of (score, id) and sorted there; a row's rank is its place in its partition
    plus the row counts of the partitions before, so no task sees more than its range.
    """
    order = [F.desc("score"), F.col(id_col)]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    folder = f"{shared_folder(scored.sparkSession)}/resample-{uuid.uuid4().hex}"
    dealt.write.parquet(folder)
    placed = scored.sparkSession.read.parquet(folder).withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("many"))  # a row a partition
    before = F.coalesce(F.sum("many").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    found = placed.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    return found.withColumn("rank", F.when(rank <= drawn, rank)).select(*scored.columns, "rank")


def importance_resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (null if not drawn).

    Scored rows, without texts, are written to the shared folder once and read back.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/resample-{uuid.uuid4().hex}"
    weights = importance_weights(docs, target, id_col=id_col, text_col=text_col, buckets=buckets)
    weights.withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed)).write.parquet(folder)
    scored = spark.read.parquet(folder)
    long_enough = F.col("n_words") >= least_words
    eligible = scored.where(long_enough)
    drawn = percent * eligible.count() // 100
    return ranked(eligible, drawn, id_col).unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns kept; rows with a null id are never drawn."""
    id_col = options.get("id_col", "doc_id")
    chosen = importance_resample(docs, target, **options).where("rank IS NOT NULL").select(F.col(id_col).alias("_drawn")).distinct()
    return docs.join(chosen, docs[id_col] == chosen["_drawn"], "left_semi")
