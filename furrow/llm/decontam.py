"""Benchmark decontamination by a broadcast set of normalised test n-grams.

The benchmark's windows are a table with one row per distinct n-gram. A fixed-size bit set of their
hashes, built on the executors, goes into the scan as a constant: the scan hashes every token window
of a document in place and keeps only positions whose bit is set. Those few candidates carry their
words, and an equality join with the n-gram table verifies them, so a hash collision never counts.
Documents themselves never shuffle; one slim row per document does.

Defined results: a null or wordless text has no words and no hits; a benchmark item without words has
no window; an item shorter than the window length is one window of its own length; a null item id
marks words but is not listed among the items; rows that repeat a document give one result row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, let, words

WINDOW = 10
#: Most bytes of n-grams and their item ids that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 200_000_000
#: Least and most bits of the bit set (2^24 bits are 2 MB); each n-gram has 64 of them and sets two, up to some 260,000
#: n-grams. Beyond that more positions are candidates (a sixteenth at four million n-grams); the join still decides.
MIN_BITS, MAX_BITS = 1 << 12, 1 << 24


def benchmark_grams(benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row per distinct window: gram, its length in words, and the ids of the items that have it."""
    tokens = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    windows = tokens.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("g"))
    return windows.groupBy(F.concat_ws(" ", "g").alias("gram")).agg(F.first(F.size("g")).alias("len"), F.collect_set("item").alias("items"))


def _two(h: Column) -> tuple[Column, Column]:
    """Two hashes of one: its lower and its upper half."""
    return h, F.shiftrightunsigned(h, 32)


def _gram_bits(grams: DataFrame, n_grams: int) -> tuple[int, Column]:
    """The number of bits and the bit set (64 bits an element) as a constant of bounded size."""
    bits = MIN_BITS
    while bits < min(MAX_BITS, 64 * n_grams):
        bits *= 2
    h = F.xxhash64(F.split("gram", " "))
    rows = (
        grams.select(F.explode(F.array(*[x.bitwiseAND(F.lit(bits - 1)) for x in _two(h)])).alias("s"))
        .groupBy(F.shiftright("s", 6).alias("k"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v"))
        .collect()  # bits / 64 rows at most
    )
    field = [0] * (bits // 64)
    for r in rows:
        field[r.k] = r.v
    return bits, F.split(F.lit(",".join(map(str, field))), ",").cast("array<bigint>")


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bench_text: str = "text",
    item_col: str = "item_id", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans [(start, length)], items, contaminated."""
    grams = cut(benchmark_grams(benchmark, text_col=bench_text, item_col=item_col, window=window))
    weight = F.octet_length("gram") + 50 + F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 20)
    n_grams, n_bytes = grams.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # window values at most
    bits, field = _gram_bits(grams, n_grams)

    def candidates(w: Column, length: int) -> Column:
        def known(i: Column) -> Column:
            bit = lambda x: F.getbit(F.element_at(field, (F.shiftright(x, 6).bitwiseAND(F.lit(bits // 64 - 1)) + 1).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1
            low, high = _two(F.xxhash64(F.slice(w, i, length)))
            return bit(low) & bit(high)  # the second is asked only where the first bit is set

        places = F.when(F.size(w) >= length, F.sequence(F.lit(1), F.size(w) - (length - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(places, known), lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), F.concat_ws(" ", F.slice(w, i, length)).alias("gram")))

    none = F.array().cast("array<struct<start:int,length:int,gram:string>>")
    found = lambda w: F.concat(none, *[candidates(w, n) for n in lengths])
    scanned = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        let(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), found(w).alias("c"))).alias("s"),
    ).select("id", "row", "s.n_words", F.explode_outer("s.c").alias("c")).select("id", "row", "n_words", "c.start", "c.length", "c.gram")
    table = grams.select(F.col("gram").alias("known"), "items")
    table = F.broadcast(table) if n_bytes <= broadcast_bytes else table
    key = F.coalesce("gram", F.concat(F.lit(" "), F.col("row").cast("string")))  # no n-gram starts with a blank: rows without a candidate spread
    hit = F.when(F.col("items").isNotNull(), F.struct("start", "length"))
    out = (
        scanned.join(table, key == F.col("known"), "left")
        .groupBy("id", "row", "n_words")
        .agg(F.collect_set(hit).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    )
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.size(covered).cast("long").alias("n_hit"), "spans",
        F.array_sort("items").alias("items"), (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without any hit, with all their columns.

    Rows that share an id (null included) are judged together: one contaminated row removes them all.
    """
    key = free_name(docs, "dirty_id")
    dirty = contamination(docs, benchmark, id_col=id_col, **options).where("contaminated").select(F.col(id_col).alias(key)).distinct()
    return docs.join(dirty, F.col(id_col).eqNullSafe(F.col(key)), "left_anti")
