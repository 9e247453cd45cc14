"""Shards of near-equal size by best-fit-decreasing packing of indivisible groups.

Groups are documents of equal text. Sizes are summed per group with partial counts, and groups are
counted by size: groups of one size are interchangeable, so the packing sees sizes with their counts. Under
the best-fit rule a bin that took a group is the tightest for the next one of that size until it is full, so
a run of them enters at once, and the outcome is that of packing every group by itself. Sizes that differ
add up to at most the whole, so there are under sqrt(2 x bytes) of them (half a million for 100 GB, were
every size in use), whatever the number of documents; the driver gets two numbers for each. Sizes in
decreasing order enter the bin with the tightest remaining capacity, which a balanced search tree of
(remaining, bin) finds; the capacity is the smallest found for which the given number of bins is enough.

A size that went into one bin as a whole gives its groups their shard by a join on the size. The groups of a
size that was split are numbered in order of hash block and digest, so that a frequent size isn't one task. Documents
meet their group by its digest (those of hot groups by a bounded broadcast).

Slots are numbered without a global sort: documents are dealt by hash into blocks, blocks are counted,
running totals of the counts give each block its first slot.

Defined results: a null text has size 1 and is grouped with the empty text; a group larger than an even
share stays whole and takes a bin of its own; among groups of equal size the order of hash block and digest decides; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 8
#: Distinct sizes whose shards are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_SIZES = 1_000_000
#: A group of more than one in so many rows is hot; there are fewer such groups than this, so they are broadcast.
HOT_SHARE = 4096
#: Rows of one numbering block.
BLOCK_ROWS = 200_000


class _Node:
    __slots__ = ("high", "key", "left", "right")

    def __init__(self, key: tuple):
        self.key, self.left, self.right, self.high = key, None, None, 1


def _high(t: _Node | None) -> int:
    return t.high if t else 0


def _turn(t: _Node, down: str, up: str) -> _Node:
    top = getattr(t, down)
    setattr(t, down, getattr(top, up))
    setattr(top, up, t)
    for x in (t, top):
        x.high = 1 + max(_high(x.left), _high(x.right))
    return top


def _even(t: _Node) -> _Node:
    t.high = 1 + max(_high(t.left), _high(t.right))
    lean = _high(t.left) - _high(t.right)
    if lean > 1:
        if _high(t.left.left) < _high(t.left.right):
            t.left = _turn(t.left, "right", "left")
        return _turn(t, "left", "right")
    if lean < -1:
        if _high(t.right.right) < _high(t.right.left):
            t.right = _turn(t.right, "left", "right")
        return _turn(t, "right", "left")
    return t


def _put(t: _Node | None, key: tuple) -> _Node:
    if t is None:
        return _Node(key)
    if key < t.key:
        t.left = _put(t.left, key)
    else:
        t.right = _put(t.right, key)
    return _even(t)


def _take(t: _Node, key: tuple) -> _Node | None:
    if key < t.key:
        t.left = _take(t.left, key)
    elif key > t.key:
        t.right = _take(t.right, key)
    elif t.left is None or t.right is None:
        return t.left or t.right
    else:
        low = t.right
        while low.left:
            low = low.left
        t.key = low.key
        t.right = _take(t.right, low.key)
    return _even(t)


def _tightest(t: _Node | None, size: int) -> tuple | None:
    """The smallest (remaining, bin) with remaining >= size."""
    best = None
    while t:
        if t.key[0] >= size:
            best, t = t.key, t.left
        else:
            t = t.right
    return best


def best_fit(classes: Sequence[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (class, bin, items) of (size, count) classes in decreasing size; None if more than ``bins`` are needed."""
    tree, opened, out = None, 0, []
    for k, (size, left) in enumerate(classes):
        while left:
            if (found := _tightest(tree, size)) is None:
                if opened == bins or size > capacity:
                    return None
                found, opened = (capacity, opened), opened + 1
                tree = _put(tree, found)
            run = min(left, found[0] // size)
            tree = _put(_take(tree, found), (found[0] - run * size, found[1]))
            out.append((k, found[1], run))
            left -= run
    return out


def pack(classes: Sequence[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Best-fit-decreasing into ``bins`` bins of the smallest capacity found that suffices."""
    low = max([1, -(-sum(s * n for s, n in classes) // bins), *[s for s, _ in classes[:1]]])
    if (out := best_fit(classes, low, bins)) is not None:
        return out
    step = max(1, low // 100_000)
    while best_fit(classes, low + step, bins) is None:
        step *= 2
    least, most = step // 2, step
    while most - least > max(1, low // 100_000):
        mid = (least + most) // 2
        least, most = (least, mid) if best_fit(classes, low + mid, bins) is not None else (mid, most)
    return best_fit(classes, low + most, bins)


def number(rows: DataFrame, by: Sequence[str], order: Sequence[str], deal_by: str, blocks: int, out: str) -> DataFrame:
    """``rows`` with a gapless number from 0 within ``by``: rows are dealt by a hash into blocks, sorted within each, and
    the running totals of the blocks' counts give each its first number. Neither a large ``by`` nor all rows are one task."""
    dealt = cut(rows.withColumn("block", F.pmod(F.xxhash64(deal_by), F.lit(blocks)).cast("int")))
    keys = [*by, "block"]
    firsts = dealt.groupBy(*keys).agg(F.count("*").alias("n_")).withColumn("first_", F.sum("n_").over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    numbered = dealt.withColumn("within_", within).join(firsts.select(*keys, F.coalesce("first_", F.lit(0)).alias("first_")), keys)
    return numbered.withColumn(out, (F.col("first_") + F.col("within_")).cast("long")).drop("block", "within_", "first_")


def place_groups(groups: DataFrame, shards: int, *, broadcast_sizes: int = BROADCAST_SIZES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``groups`` (sha, size, ...) with the shard of each."""
    spark = groups.sparkSession
    counted = groups.groupBy("size").agg(F.count("*").alias("n")).toArrow()  # sqrt(2 x bytes) rows at most
    classes = sorted(zip(counted["size"].to_pylist(), counted["n"].to_pylist()), reverse=True)
    runs = pack(classes, shards)
    parts = Counter(k for k, _, _ in runs)
    end, table, split_table = [0] * len(classes), [], []
    for k, b, n in runs:
        if parts[k] == 1:
            table.append((classes[k][0], b))
        else:
            split_table.append((classes[k][0], end[k], end[k] + n, b))
            end[k] += n
    bounded = F.broadcast if len(runs) <= broadcast_sizes else (lambda df: df)
    most = max([n for k, (_, n) in enumerate(classes) if parts[k] > 1], default=0)
    whole = groups.join(bounded(_table(spark, ["size", "shard"], table)), "size")
    if not split_table:
        return whole
    sizes = _table(spark, ["size", "from_", "to_", "shard"], split_table)
    split = groups.join(bounded(sizes.select("size").distinct()), "size", "left_semi")
    ranked = number(split, ["size"], ["sha"], "sha", max(1, -(-most // block_rows)), "rank_")
    inside = (F.col("rank_") >= F.col("from_")) & (F.col("rank_") < F.col("to_"))
    return whole.unionByName(ranked.join(bounded(sizes), "size").where(inside).drop("rank_", "from_", "to_"))


def _table(spark: SparkSession, names: Sequence[str], rows: list[tuple]) -> DataFrame:
    types = {n: pa.int32() if n == "shard" else pa.int64() for n in names}
    columns = list(zip(*rows)) or [[] for _ in names]
    return spark.createDataFrame(pa.table({n: pa.array(v, t) for (n, t), v in zip(types.items(), columns)}))


def shard(docs: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", hot_share: int = HOT_SHARE, block_rows: int = BLOCK_ROWS, broadcast_sizes: int = BROADCAST_SIZES) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("sha"), F.monotonically_increasing_id().alias("row")))
    n = rows.count()
    groups = cut(rows.groupBy("sha").agg(F.sum("size").alias("size"), F.count("*").alias("n")).select("sha", "size", (F.col("n") * hot_share > n).alias("hot")))
    by_group = cut(place_groups(groups, shards, broadcast_sizes=broadcast_sizes, block_rows=block_rows).select("sha", "hot", "shard"))
    hot, cool = F.broadcast(by_group.where("hot").select("sha", "shard")), by_group.where("not hot").select("sha", "shard")
    in_shard = rows.join(hot, "sha").unionByName(rows.join(hot.select("sha"), "sha", "left_anti").join(cool, "sha"))
    placed = number(in_shard.select("id", "size", "crc", "shard", "row"), ["shard"], ["id", "row"], "row", max(16, -(-n // (block_rows * shards))), "slot")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
