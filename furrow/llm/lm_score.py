"""Language-model scores by online logistic context mixing over distributed n-gram statistics.

A text's tokens (lower-cased words and an end mark) are coded as binary decisions. First: is the token the
most frequent successor of its two words before, in the training corpus? If not: is it the word that last
followed the word before in this text? If not, the bits of its frequency class follow (class k holds the
words with 2^(k-1) to 2^k - 1 training occurrences), then the word's share of its class; a word without
training occurrences has class 0 and is spelled by the bits of its bytes.

Three predictors give each decision a probability, looked up by contexts of growing order: for candidates
how often they were seen, what became of the last ones in this text, and the classes around; for class bits
the place in the class code alone, with the class before, with the two classes before; for a byte's bits the
hashed one, two and three bytes before. Weights that a gate selects mix the stretched predictions. They start
alike for every text, and are refined while it is read, after each ``BLOCK`` tokens.
The text's own words serve as candidates as soon as they were read.

What is gathered grows with the corpus: words and successors are counted over all training documents in
hash buckets. Documents are packed into chunks; a chunk sends a bucket the distinct keys it holds, in one
row, and gets their counts back, so that the most frequent word costs a chunk one entry and no bucket or
chunk is larger than its parameter says. Predictor tables are sums over all chunks, so that scores don't
depend on how documents are dealt to chunks.
Rows grow with the number of chunks times that of buckets; raise both sizes with the executors' memory.

A training document is scored with its own occurrences taken out of the counts, the candidates' and the
classes' totals included, as if it were unseen (the base isn't: that is defined over all training tokens, and the
predictor tables hold every document). For each context a chunk asks for one successor more than any of its
documents has, so that the most frequent of the others is always among them. Words are compared by 64-bit hashes, successors by 24 bits,
contexts by 28 bits within their bucket.

Defined results: null and empty texts are one end token; a null id counts as the empty text for the fold;
repeated rows are documents of their own and know each other's words; without training tokens the base is
0 and odds are even; a text longer than a chunk is a chunk of its own; other columns aren't read, so their
names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK as VECTOR_BLOCK, shared_folder, sum_vectors, vector_blocks

FOLDS = 10
END = b""
#: Bytes of text of a chunk (about six a token), and keys of a bucket.
CHUNK, BUCKET = 3_000_000, 1_000_000
#: Tokens between two updates of the weights, the rate of an update, and the weight that each predictor starts with.
BLOCK, RATE, START = 16, 0.02, 0.4
#: Gates: 4 of successors, 2 of local words, 6 by depth of a class bit, 8 by place of a bit in its byte.
_BITS = 12
GATES = _BITS + 8
#: Classes are at most 2^6; tables hold the class bits' contexts, behind them the candidates', then those of spelled bits.
_CLASS = 64
_SIDE = _CLASS**3
_SPELL = _SIDE + 4096
SPELLED = 17
SLOTS = _SPELL + (1 << SPELLED)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def tokens_in(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(distinct words as they first occur, joined by blanks and the end mark in front; the tokens of all texts as places there; how many each has)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    at = np.asarray(split.offsets).astype(np.int64) - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    words, index = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int32) + 1
    if "" in words:  # beside white space at the ends of a text
        empty = words.index("") + 1
        used = np.concatenate([[0], np.cumsum(index != empty)])
        at, index = used[at], index[index != empty]
        index[index > empty] -= 1
        words.remove("")
    lens = np.diff(at) + 1
    return " ".join([END.decode(), *words]).encode("utf-8", "surrogatepass"), np.insert(index, at[1:], 0), lens


def fold(id_col: str, folds: int = FOLDS):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


_ZSTD = pa.Codec("zstd", 1)


def squeezed(x: np.ndarray) -> bytes:
    """An array's bytes behind their length, compressed plane by plane: all first bytes, all second ones and so on."""
    planes = x.reshape(-1, 1).view(np.uint8).T.tobytes()
    return len(planes).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def opened(data: bytes, kind) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(memoryview(data)[8:], size, asbytes=True), np.uint8)
    if width == 1:
        return planes.view(kind)
    planes, whole = planes.reshape(width, -1), np.dtype(f"<u{width}")
    out = planes[0].astype(whole)
    for k in range(1, width):
        if planes[k].any():
            out |= planes[k].astype(whole) << whole.type(8 * k)
    return out.view(kind)


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, from 0 on; ``np.cumsum`` undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows written in buckets of their chunk: what several such tables say of a chunk is joined without a shuffle.

    The catalogue forgets the table once it was looked up; its files stay in ``folder``.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"scores_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "chunk").option("path", f"{folder}/{name}").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


# --- chunks of documents

_CHUNK_SCHEMA = "chunk bigint, total bigint, ids array<{0}>, held binary, n_bytes binary, lens binary, words binary, tokens binary"


def chunks(docs: DataFrame, *, id_col: str, text_col: str, folds: int = FOLDS, size: int = CHUNK) -> DataFrame:
    """Documents in chunks, the longest first: their ids, folds, bytes and lengths, the distinct words as they first occur, and the tokens as places there."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = _CHUNK_SCHEMA.format(kind)

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            ends = np.cumsum(np.asarray(b.column(2)) + 1)
            cuts = (np.flatnonzero(np.diff(ends // size)) + 1).tolist()
            for x, y in zip([0, *cuts], [*cuts, b.num_rows]):
                order = pa.array(x + np.argsort(-np.asarray(b.column(2).slice(x, y - x)), kind="stable"))
                some_ids, held, n_bytes, texts = (b.column(j).take(order) for j in range(4))
                words, flat, lens = tokens_in(texts)
                blobs = [np.asarray(held.to_numpy(zero_copy_only=False), bool), np.asarray(n_bytes).astype(np.int64), lens]
                data = [v.tobytes() for v in blobs] + [squeezed(v) for v in (np.frombuffer(words, np.uint8), flat)]
                ids = pa.ListArray.from_arrays(pa.array([0, y - x], pa.int32()), some_ids)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(flat)], pa.int64()), ids, *(pa.array([v], pa.binary()) for v in data)], names=names)
                k += 1

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), (fold(id_col, folds) == 0).alias("held"), F.octet_length(text).cast("long").alias("n"), text.alias("t")).mapInArrow(run, schema)


def ranked(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by integer keys from 0 on, rows with equal keys as they are."""
    n = len(keys[0])
    widths = [int(k.max(initial=0)).bit_length() for k in keys]
    last = max(1, (n - 1).bit_length())
    if sum(widths) + last > 63:
        return np.lexsort(keys[::-1])
    packed = np.zeros(n, np.int64)
    for k, w in zip(keys, widths):
        packed = (packed << w) | k
    packed = np.sort((packed << last) | np.arange(n))
    return packed & ((1 << last) - 1)


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


class Chunk:
    """The arrays of one chunk row; its words in order of their hashes."""

    def __init__(self, row: dict):
        self.ids, words = row["ids"], opened(row["words"], np.uint8).tobytes().split(b" ")
        self.held, self.n_bytes, self.lens = np.frombuffer(row["held"], bool), np.frombuffer(row["n_bytes"], np.int64), np.frombuffer(row["lens"], np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(hashes)  # words are dealt and answered in order of their hashes
        self.hashes, self.words = hashes[order], [words[k] for k in order.tolist()]
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        self.tokens = place[opened(row["tokens"], np.int32)]
        self.first = np.cumsum(self.lens) - self.lens
        self.doc = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        self.training = np.repeat(~self.held, self.lens)
        self.end = place[0]

    def find_contexts(self, bits: int) -> None:
        one, two = np.empty_like(self.tokens), np.empty_like(self.tokens)
        for to, source in ((one, self.tokens), (two, one)):
            to[1:] = source[:-1]
            to[self.first] = self.end  # the end mark stands before a text, too
        self.short = (self.hashes >> np.uint64(40)).astype(np.int32)[self.tokens]  # the token's 24 bits
        # tokens by context and place: those of one document are side by side in a context
        self.by_context = ranked(one, two)
        starts = runs(one[self.by_context], two[self.by_context])
        some = self.by_context[starts]
        h = (self.hashes[one[some]] * _A + self.hashes[two[some]]) * _B
        key = (h ^ (h >> np.uint64(29))) >> np.uint64(36 - bits)  # the bucket's bits and 28 within
        order = ranked(key.astype(np.int64))
        #: Contexts in order of their keys, and the place of each token's there.
        self.contexts = key[order]  # of 28 + bits bits
        group = np.empty(len(order), np.int32)
        group[order] = np.arange(len(order), dtype=np.int32)
        #: The places in the order of ``by_context``.
        self.places = np.repeat(group, np.diff(starts, append=len(self.tokens)))

    def successors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of a context, 24 bits of a successor, count) of the training documents' pairs, in order."""
        at = self.training[self.by_context]
        pairs = np.sort((self.places[at].astype(np.int64) << 24) | self.short[self.by_context[at]])
        starts = runs(pairs)
        return pairs[starts] >> 24, pairs[starts] & 0xFFFFFF, np.diff(starts, append=len(pairs))

    def wanted(self) -> np.ndarray:
        """How many successors of a context must be known: one more than a training document here has distinct ones, 1 without any."""
        at = self.training[self.by_context]
        place, at = self.places[at], self.by_context[at]
        starts = runs(place, self.doc[at])
        sizes = np.diff(starts, append=len(at))
        again = np.repeat(sizes > 1, sizes)
        run = np.repeat(np.arange(len(starts)), sizes)[again]
        distinct = np.bincount(np.unique((run << 24) | self.short[at][again]) >> 24, minlength=len(starts))
        out = np.ones(len(self.contexts), np.uint32)
        np.maximum.at(out, place[starts], 1 + np.maximum(distinct, 1).astype(np.uint32))
        return out

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.training], minlength=len(self.hashes))


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


# --- counts by exchange with hash buckets


def _edges(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Where each bucket begins among ordered keys of ``width`` bits, and the end."""
    return np.searchsorted(keys >> np.uint64(width - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def word_requests(packed: DataFrame, bits: int) -> DataFrame:
    """(bucket, chunk, keys, n): a chunk's distinct words in a bucket with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                c = Chunk(row)
                n, at = c.word_counts().astype(np.int64), _edges(c.hashes, bits, 64)
                used = np.flatnonzero(np.diff(at)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([row["chunk"]] * len(used), pa.int64()), *(pa.array([squeezed(f(x[at[k] : at[k + 1]])) for k in used], pa.binary()) for f, x in ((steps, c.hashes), (np.asarray, n)))],
                    names=["bucket", "chunk", "keys", "n"],
                )

    return packed.mapInArrow(run, "bucket int, chunk bigint, keys binary, n binary")


def word_answers(table: pa.Table) -> pa.Table:
    """The training count of each asked word, a row for each chunk; rows without a chunk have the bucket's words and tokens by class."""
    keys = [np.cumsum(opened(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    n = np.concatenate([opened(x, np.int64) for x in table.column("n").to_pylist()])
    place = np.unique(np.concatenate(keys), return_inverse=True)[1]
    total = np.zeros(int(place.max()) + 1, np.int64)
    np.add.at(total, place, n)
    ends = np.cumsum([len(x) for x in keys])
    data = [squeezed(x) for x in np.split(total[place], ends[:-1])]
    klass = classes(total)
    words, sums = np.bincount(klass, minlength=_CLASS), np.zeros(_CLASS, np.int64)
    np.add.at(sums, klass, total)
    used = [k for k in range(1, _CLASS) if words[k]]
    bucket = table.column("bucket")[0].as_py()
    return pa.table({
        "chunk": pa.array([*table.column("chunk").to_pylist(), *[None] * len(used)], pa.int64()), "bucket": pa.array([bucket] * (len(data) + len(used)), pa.int32()), "data": pa.array([*data, *[None] * len(used)], pa.binary()),
        "class": pa.array([*[None] * len(data), *used], pa.int32()), "words": pa.array([*[None] * len(data), *words[used].tolist()], pa.int64()), "total": pa.array([*[None] * len(data), *sums[used].tolist()], pa.int64()),
    })


def classes(counts: np.ndarray) -> np.ndarray:
    """0 for none, else the number of binary digits."""
    return np.frexp(counts.astype(np.float64))[1] * (counts > 0)  # int32


def successor_requests(packed: DataFrame, bits: int) -> DataFrame:
    """(bucket, chunk, keys, want, sizes, next, n): a chunk's contexts in a bucket, how many successors it asks for, and its own training successors (``sizes`` of each context) with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                c = Chunk(row)
                c.find_contexts(bits)
                owner, after, n = c.successors()
                keys, sizes = c.contexts, np.bincount(owner, minlength=len(c.contexts)).astype(np.uint32)
                at = _edges(keys, bits, 28 + bits)
                behind = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[at]
                key32 = (keys & np.uint64(0xFFFFFFF)).astype(np.uint32)
                used = np.flatnonzero(np.diff(at)).tolist()
                cut = lambda x, ends, f=np.asarray: pa.array([squeezed(f(x[ends[k] : ends[k + 1]])) for k in used], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([row["chunk"]] * len(used), pa.int64()), cut(key32, at, steps), cut(c.wanted(), at), cut(sizes, at), cut(after.astype(np.uint32), behind), cut(n.astype(np.uint32), behind)],
                    names=["bucket", "chunk", "keys", "want", "sizes", "next", "n"],
                )

    return packed.mapInArrow(run, "bucket int, chunk bigint, keys binary, want binary, sizes binary, next binary, n binary")


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... in each of several runs of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def _among(ordered: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether each asked key is among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(asked), bool)
    return ordered[np.minimum(np.searchsorted(ordered, asked), len(ordered) - 1)] == asked


def successor_answers(table: pa.Table) -> pa.Table:
    """Of each asked context its successors' count, and as many as were asked for of the most frequent (ties: the larger bits) with theirs; a row for each chunk.

    A list ends with the first successor that the asking chunk doesn't have itself: none of its documents can lower that one's count.
    A context that has no training occurrence outside the asking chunk gets none: the chunk knows all of it.
    """
    part = lambda name: [opened(x, np.uint32) for x in table.column(name).to_pylist()]
    keys, want, sizes, n = [np.cumsum(x, dtype=np.uint32) for x in part("keys")], part("want"), part("sizes"), part("n")
    asked = np.concatenate(keys).astype(np.int64)
    order = ranked(asked)
    starts = runs(asked[order])
    place = np.empty(len(asked), np.int64)
    place[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(asked)))
    owner, after, each = np.repeat(place, np.concatenate(sizes)), np.concatenate(part("next")).astype(np.int64), np.concatenate(n).astype(np.int64)
    order = ranked(owner, after)
    heads = runs(owner[order], after[order])
    sums = np.add.reduceat(each[order], heads) if len(heads) else each
    owner, after = owner[order][heads], after[order][heads]
    total = np.bincount(owner, sums, minlength=len(starts)).astype(np.int64)
    known = np.bincount(owner, minlength=len(starts))
    order = len(owner) - 1 - ranked(owner[::-1], sums.max(initial=0) - sums[::-1])  # from the most frequent on, the larger bits first
    after, sums, first = after[order], sums[order], np.cumsum(known) - known
    data, a = [], 0
    for k, asks, size, own, theirs in zip(keys, want, sizes, n, part("next")):
        mine = place[a : a + len(k)]
        holder = np.repeat(np.arange(len(k)), size)
        elsewhere = total[mine] > np.bincount(holder, own, minlength=len(k))
        given = np.where(elsewhere, np.minimum(known[mine], asks), 0)
        context, at = np.repeat(np.arange(len(k)), given), spread(first[mine], given)
        foreign = np.cumsum(~_among((holder << 24) | theirs, (context << 24) | after[at]))
        before = np.concatenate([[0], foreign])[np.cumsum(given) - given]  # foreign successors of earlier contexts
        keep = np.concatenate([[0], foreign])[:-1] == np.repeat(before, given)
        given, at = np.bincount(context[keep], minlength=len(k)), at[keep]
        data.append(squeezed(np.concatenate([x.astype(np.uint32) for x in (given, total[mine] * elsewhere, after[at], sums[at])])))
        a += len(k)
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "contexts": pa.array([len(k) for k in keys], pa.int64()), "data": pa.array(data, pa.binary())})


class Successors(NamedTuple):
    """Of contexts in order: how many successors are listed, the count of all, and the lists' bits and counts."""

    given: np.ndarray
    total: np.ndarray
    after: np.ndarray
    n: np.ndarray


def known_successors(c: Chunk, answered: Successors) -> Successors:
    """The answers, and the chunk's own successors of the contexts that have none elsewhere."""
    alone = answered.total == 0
    owner, after, n = c.successors()
    keep = alone[owner]
    owner, after, n = owner[keep], after[keep], n[keep]
    mine = np.bincount(owner, minlength=len(alone))
    total = np.where(alone, np.bincount(owner, n, minlength=len(alone)).astype(np.int64), answered.total)
    given = answered.given + mine
    here = np.repeat(alone, given)  # a context has a list from one side only

    def merged(theirs: np.ndarray, ours: np.ndarray) -> np.ndarray:
        out = np.empty(len(here), np.int64)
        out[here], out[~here] = ours, theirs
        return out

    return Successors(given, total, merged(answered.after, after), merged(answered.n, n))


# --- decisions


class Part(NamedTuple):
    """Decisions in order of their blocks: outcome, three slots (from ``low`` on), and the place of the weights (document and gate); ``ends`` counts those up to each block's end."""

    y: np.ndarray
    slots: tuple[np.ndarray, np.ndarray, np.ndarray]
    low: int
    at: np.ndarray
    ends: np.ndarray


def _own(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How often each asked key is among the keys."""
    distinct, n = np.unique(keys, return_counts=True)
    if not len(distinct):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(distinct, asked), len(distinct) - 1)
    return np.where(distinct[at] == asked, n[at], 0)


def _level(n: np.ndarray) -> np.ndarray:
    return np.minimum(classes(n), 7)


def _last_outcomes(c: Chunk, outcome: np.ndarray) -> np.ndarray:
    """The three outcomes before each token in its text, as a number in base 3."""
    one = np.zeros(len(outcome), np.int32)
    one[1:] = outcome[:-1]
    one[c.first] = 0
    two, three = np.zeros_like(one), np.zeros_like(one)
    two[1:] = one[:-1]
    two[c.first] = 0
    three[1:] = two[:-1]
    three[c.first] = 0
    return one + 3 * two + 9 * three


def candidates(c: Chunk, successors: Successors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the most frequent successor of each token's context, the level of its count, that of the others' count), a training document's own occurrences taken out; zeros without any. Ties: the larger bits."""
    listed = known_successors(c, successors)
    at = c.by_context
    starts = runs(c.places, c.doc[at])  # a context in one document
    sizes = np.diff(starts, append=len(at))
    place, head = c.places[starts], at[starts]
    training, given = c.training[head], listed.given[place]
    entry, owner = spread((np.cumsum(listed.given) - listed.given)[place], given), np.repeat(np.arange(len(starts)), given)
    after, left = listed.after[entry], listed.n[entry]
    # a context that a training document has once lowers the count of the token there, others by a search
    once = training & (sizes == 1)
    left -= np.where(once, c.short[head], -1)[owner] == after
    often = training & (sizes > 1)
    if often.any():
        mine, asked = np.flatnonzero(np.repeat(often, sizes)), np.flatnonzero(often[owner])
        run = np.repeat(np.flatnonzero(often), sizes[often])
        left[asked] -= _own((run << 24) | c.short[at[mine]], (owner[asked] << 24) | after[asked])
    best, most = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    some = np.flatnonzero(given)
    if len(some):
        top = np.maximum.reduceat((np.maximum(left, 0) << 24) | after, (np.cumsum(given) - given)[some])
        best[some], most[some] = top & 0xFFFFFF, top >> 24
    others = listed.total[place] - np.where(training, sizes, 0) - most
    out = []
    for x, kind in ((best * (most > 0), np.int32), (_level(most), np.int8), (_level(np.maximum(others, 0)), np.int8)):
        full = np.empty(len(at), kind)
        full[at] = np.repeat(x.astype(kind), sizes)
        out.append(full)
    return tuple(out)


def decisions(c: Chunk, counts: np.ndarray, successors: Successors, depth: int, only: np.ndarray | None = None) -> tuple[list[Part], np.ndarray, np.ndarray]:
    """(parts, the count of each token as seen from its document, which tokens no candidate named); ``only``: the tokens that decisions are told of. """
    n = len(c.tokens)
    best, level, others = candidates(c, successors)
    # a training document's own occurrences of a word don't count
    at = ranked(c.tokens)
    starts = runs(c.tokens[at], c.doc[at])
    sizes = np.diff(starts, append=n)
    seen = np.empty(n, np.int64)
    seen[at] = np.repeat(counts[c.tokens[at[starts]]] - np.where(c.training[at[starts]], sizes, 0), sizes)
    past = np.empty(n, np.int32)  # where the token was before in its text
    past[at[1:]] = at[:-1]
    past[at[starts]] = -1
    # the word that last followed the word before in this text
    local = np.full(n, -1, np.int32)
    local[1:] = np.where(past[:-1] >= 0, past[:-1] + 1, -1)
    local[c.first] = -1
    klass = classes(seen)
    before, two_before = np.zeros(n, np.int32), np.zeros(n, np.int32)
    before[1:], two_before[2:] = klass[:-1], klass[:-2]
    before[c.first] = two_before[c.first] = 0
    two_before[c.first[c.lens > 1] + 1] = 0

    offered = level > 0
    hit = offered & (best == c.short)
    outcome = offered * 1 + hit
    known = local >= 0
    near = np.maximum(local, 0)
    word, agrees = c.tokens[near], known & (c.short[near] == best)
    asked = known & ~hit & ~(offered & agrees)
    found = asked & (word == c.tokens)
    left = ~hit & ~found

    since = np.arange(n) - np.repeat(c.first, c.lens)
    block = since // BLOCK
    order = ranked(block)  # documents stay in order within a block
    if only is not None:
        order = order[only[order]]
    blocks = np.arange(1, int(block.max()) + 2 if n else 1)

    def part(tokens: np.ndarray, y: np.ndarray, gate: np.ndarray, slots: list[np.ndarray], low: int) -> Part:
        wide = y.shape[1] if y.ndim > 1 else 1
        at = c.doc[tokens] * np.int32(GATES)
        flat = lambda x, kind=np.int32: np.broadcast_to(x.astype(kind, copy=False), y.shape).ravel()
        return Part(flat(y, np.int8), tuple(flat(s) for s in slots), low, flat((at[:, None] if wide > 1 else at) + gate), wide * np.searchsorted(block[tokens], blocks))

    t = order[offered[order]]
    high, past = level[t].astype(np.int32), _last_outcomes(c, outcome)[t]
    parts = [part(t, hit[t], np.minimum(high - 1, 3), [_SIDE + high * 8 + others[t], _SIDE + high * 27 + past, _SIDE + (1 * known[t] + agrees[t]) * _CLASS + before[t]], _SIDE)]
    t = order[asked[order]]
    near = _last_outcomes(c, asked * 1 + found)[t]
    far = np.minimum(classes(t - local[t]), 15)
    parts.append(part(t, found[t], (4 + (near % 3 == 2)).astype(np.int32), [_SIDE + 1024 + far, _SIDE + 1024 + near * 2 + offered[t], _SIDE + 1024 + klass[local[t]]], _SIDE))
    t = order[left[order]]
    j = np.arange(depth, dtype=np.int32)
    k = klass[t][:, None]
    node = (1 << j) | (k >> (depth - j))
    first = node * np.int32(_CLASS) + before[t][:, None]
    parts.append(part(t, (k >> (depth - 1 - j)) & 1, np.minimum(6 + j, _BITS - 1), [node, first, first * np.int32(_CLASS) + two_before[t][:, None]], 0))
    t = t[seen[t] == 0]
    y, sizes, slots = spelled(c, t)
    ends = np.concatenate([[0], np.cumsum(8 * sizes)])[np.searchsorted(block[t], blocks)]
    at = np.repeat(c.doc[t] * np.int32(GATES), sizes)[:, None] + np.arange(_BITS, GATES, dtype=np.int32)
    parts.append(Part(y, slots, _SPELL, at.ravel(), ends))
    return parts, seen, left


def stretched(ones: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A predictor's table: log odds of a one in each slot."""
    return np.clip(np.log((ones + 0.4) / (seen - ones + 0.4)), -9, 9).astype(np.float32)


def read(parts: list[Part], tables: list[np.ndarray], docs: int) -> np.ndarray:
    """The natural log probability of each document's decisions; a document's weights (gate, predictor and bias) are refined after each block. Parts have gates of their own, so that a block's decisions are read together."""
    weights = [np.tile(w, docs) for w in first_weights().T]
    out = np.zeros(docs * GATES)
    starts = [np.concatenate([[0], p.ends]).tolist() for p in parts]
    for s in range(max(len(p.ends) for p in parts)):
        spans = [(p, at[s], at[s + 1]) for p, at in zip(parts, starts) if s + 1 < len(at) and at[s] < at[s + 1]]
        if not spans:
            continue
        together = lambda of: np.concatenate([of(p)[a:b] for p, a, b in spans])
        g = together(lambda p: p.at).astype(np.intp)
        x = [t.take(together(lambda p: p.slots[k])) for k, t in enumerate(tables)]
        z = weights[3].take(g)
        for k in range(3):
            z += x[k] * weights[k].take(g)
        np.clip(z, -14, 14, out=z)
        error = together(lambda p: p.y) - 1 / (1 + np.exp(-z))
        used = int(g.max()) + 1
        out[:used] += np.bincount(g, np.log(1 - np.abs(error)), minlength=used)
        error *= np.float32(RATE)
        for k in range(4):
            weights[k][:used] += np.bincount(g, error * x[k] if k < 3 else error, minlength=used)
    return out.reshape(docs, GATES).sum(axis=1)


@dataclass
class Model:
    tables: list[np.ndarray]
    totals: np.ndarray  # training tokens by class
    depth: int
    tokens: int
    distinct: int


def _arrays(row: dict) -> tuple[Chunk, np.ndarray, Successors]:
    """(chunk, counts of its words, the answers on its contexts)."""
    c = Chunk(row)
    c.find_contexts(row["bits"])
    data = [x["data"] for x in sorted(row["word_data"], key=lambda x: x["bucket"])]
    counts = np.concatenate([opened(x, np.int64) for x in data])
    parts = []
    for x in sorted(row["next_data"], key=lambda x: x["bucket"]):
        v, k = opened(x["data"], np.uint32).astype(np.int64), x["contexts"]
        lists = (len(v) - 2 * k) // 2
        parts.append(np.split(v, [k, 2 * k, 2 * k + lists]))
    return c, counts, Successors(*map(np.concatenate, zip(*parts)))


def spelled(c: Chunk, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bits, how many bytes each token has, three slots of each bit): words and a blank, from the high bit on; blanks stand before a word, too."""
    used = [c.words[k] + b" " for k in c.tokens[tokens].tolist()]
    raw = np.frombuffer(b"".join(used), np.uint8).astype(np.int32)
    sizes = np.fromiter(map(len, used), np.int64, len(used))
    at = spread(np.zeros(len(sizes), np.int64), sizes)
    one, two, three = (np.where(at >= k, np.roll(raw, k), 32) for k in (1, 2, 3))
    j = np.arange(8, dtype=np.int32)
    node = (1 << j) | (raw[:, None] >> (8 - j))

    place = node.astype(np.uint64) * _A

    def slot(context: np.ndarray) -> np.ndarray:
        key = (context.astype(np.uint64) << np.uint64(8)) * _A
        return ((key[:, None] + place) >> np.uint64(64 - SPELLED)).astype(np.int32).ravel() + np.int32(_SPELL)

    slots = ((_SPELL + one[:, None] * 256 + node).astype(np.int32).ravel(), slot(one * 256 + two), slot((one * 256 + two) * 256 + three))
    return ((raw[:, None] >> (7 - j)) & 1).astype(np.int8).ravel(), sizes, slots


def learn(row: dict, depth: int) -> np.ndarray:
    """Slots' zeros and ones of the three tables, of a chunk's training documents."""
    c, counts, successors = _arrays(row)
    parts, _, _ = decisions(c, counts, successors, depth, c.training)
    out = np.zeros((3, 2 * SLOTS), np.int64)
    for p in parts:
        for k, slots in enumerate(p.slots):
            n = np.bincount(2 * (slots - np.int32(p.low)) + p.y)
            out[k, 2 * p.low : 2 * p.low + len(n)] += n
    return out


def first_weights() -> np.ndarray:
    w = np.full((GATES, 4), START, np.float32)
    w[:, 3] = 0
    return w


def class_totals(c: Chunk, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Training tokens by document and class, a training document's own occurrences taken out: its words count in the classes that they have without them."""
    out = np.repeat(totals[None], len(c.lens), axis=0)
    pairs, own = np.unique((c.doc[c.training].astype(np.int64) << 32) | c.tokens[c.training], return_counts=True)
    doc, n = pairs >> 32, counts[pairs & 0xFFFFFFFF]
    for x, sign in ((n, -1), (n - own, 1)):
        out += sign * np.bincount(doc * _CLASS + classes(x), x, minlength=out.size).astype(np.int64).reshape(out.shape)
    return out


def scores(row: dict, model: Model) -> tuple:
    """(ids, held_out, bytes, tokens, known, base, log10 probability) of a chunk's documents."""
    c, counts, successors = _arrays(row)
    parts, seen, left = decisions(c, counts, successors, model.depth)
    m = len(c.lens)
    total = read(parts, model.tables, m) / math.log(10)
    named = left & (seen > 0)
    inside = class_totals(c, counts, model.totals)[c.doc[named], classes(seen[named])]
    total += np.bincount(c.doc[named], np.log10(seen[named] / inside), minlength=m)
    n = counts[c.tokens]
    base = np.bincount(c.doc, np.log10((n + 0.1) / (model.tokens + 0.1 * (model.distinct + 1))), minlength=m)
    return c.ids, c.held, c.n_bytes, c.lens, np.bincount(c.doc[n > 0], minlength=m), base, total


# --- the jobs


def prepared(docs: DataFrame, folder: str, *, id_col: str, text_col: str, folds: int = FOLDS, chunk: int = CHUNK, bucket: int = BUCKET) -> tuple[DataFrame, dict]:
    """(chunks with the counts of all their words and contexts, the corpus's words and tokens by class). A chunk is read with its answers, without a shuffle."""
    spark = docs.sparkSession
    packed = stored(chunks(docs, id_col=id_col, text_col=text_col, folds=folds, size=chunk), folder, "chunks")
    tokens = packed.agg(F.sum("total")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(28, max(4, math.ceil(math.log2(max(2 * parts, tokens / bucket)))))
    by_word = word_requests(packed, bits).groupBy("bucket").applyInArrow(word_answers, "chunk bigint, bucket int, data binary, class int, words bigint, total bigint")
    answered = stored(by_word.repartition(parts, "chunk", "class"), folder, "words")  # rows without a chunk are spread by class
    sums = {r["class"]: (r.words, r.total) for r in answered.where("chunk IS NULL").groupBy("class").agg(F.sum("words").alias("words"), F.sum("total").alias("total")).collect()}  # 63 rows at most
    by_next = successor_requests(packed, bits).groupBy("bucket").applyInArrow(successor_answers, "chunk bigint, bucket int, contexts bigint, data binary")
    told = lambda df, name, *more: df.groupBy("chunk").agg(F.collect_list(F.struct("bucket", *more, "data")).alias(name))  # noqa: E731  a chunk's own answers
    named, after = told(answered.where("chunk IS NOT NULL"), "word_data"), told(stored(by_next.repartition(parts, "chunk"), folder, "next"), "next_data", "contexts")
    return packed.join(named, "chunk").join(after, "chunk").withColumn("bits", F.lit(bits)), sums


def train(ready: DataFrame, sums: dict) -> Model:
    depth = max(1, max(sums, default=0).bit_length())
    size = 3 * 2 * SLOTS
    room = size + -size % VECTOR_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(room, np.int64)
        for b in batches:
            for row in rows_of(b):
                total[:size] += learn(row, depth).ravel()
        blocks, data = vector_blocks(total)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])

    slots = sum_vectors(ready.mapInArrow(run, "block int, data binary"), room)[:size].reshape(3, SLOTS, 2)
    totals = np.zeros(_CLASS, np.int64)
    for k, (_, n) in sums.items():
        totals[k] = n
    return Model([stretched(x[:, 1], x.sum(axis=1)) for x in slots], totals, depth, int(totals.sum()), sum(w for w, _ in sums.values()))


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    ready, sums = prepared(docs, folder, id_col=id_col, text_col=text_col, folds=folds, chunk=chunk, bucket=bucket)
    model = train(ready, sums)
    shared = spark.sparkContext.broadcast(model)  # tables of a fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type = b.column(b.schema.get_field_index("ids")).type.value_type
            for row in rows_of(b):
                ids, held, n_bytes, n, known, base, score = scores(row, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(held), pa.array(n_bytes), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], names=["id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "score"])

    out = ready.mapInArrow(run, f"id {kind}, held_out boolean, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    bits = -F.col("score") / F.lit(math.log10(2)) / F.greatest("n_bytes", F.lit(1))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
