"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import shared_folder

#: Words as most contracts take them, from text whose A-Z are lower-cased.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter alone; null becomes the empty string.

    Pure ASCII takes the fast built-in; other text is translated letter by letter.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The lower-cased words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAK), "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (optimizer rewrites can't duplicate it)."""
    return F.transform(F.array(value), body)[0]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    What earlier steps shuffled and checkpointed and nobody refers to any more is then let go: Spark's
    cleaner removes it once the driver has collected its garbage, which a driver with little to do puts off.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


#: Bits of one bitmap (Spark's bitmap functions fix it), and the least and most bits of a field of them (2^30 bits are 128 MB).
BUCKET = 32768
MIN_BITS, MAX_BITS = 1 << 16, 1 << 30


def field_bits(entries: int, per_entry: int = 16) -> int:
    """The size of a bit field for so many entries; beyond the largest more rows pass it, none is lost."""
    bits = MIN_BITS
    while bits < min(MAX_BITS, per_entry * entries):
        bits *= 2
    return bits


def bitmaps(slots: DataFrame, slot: str = "slot") -> DataFrame:
    """(bucket, bitmap) of a table's slots, as 4 KB bitmaps."""
    return slots.groupBy(F.shiftright(slot, 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col(slot) % BUCKET).alias("bitmap"))


def has_bit(bitmap: Column, slot: Column) -> Column:
    """Whether a slot's bit is set in its bucket's bitmap; false where there is none."""
    at = slot % BUCKET
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def split_by_field(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, DataFrame]:
    """(possible, others): rows whose key may be among the wanted keys, and rows whose key certainly isn't.

    A bit field of the wanted keys' hashes is broadcast (``MAX_BITS`` / 8 bytes at most), so that rows of
    the second kind need no shuffle. The first kind has few others among it; an equality join decides there.
    """
    bits = field_bits(wanted.count())
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    field = cut(bitmaps(wanted.select(slot(F.col(wanted_key)).alias("slot"))))
    bucket, bitmap, seen = free_name(rows, "bucket"), free_name(rows, "bitmap"), free_name(rows, "seen")
    side = F.broadcast(field.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
    s = slot(F.col(key))
    marked = rows.join(side, F.shiftright(s, 15) == F.col(bucket), "left").withColumn(seen, has_bit(F.col(bitmap), s))
    return marked.where(seen).select(*rows.columns), marked.where(~F.col(seen)).select(*rows.columns)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a longer name that no column of ``df`` has (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: Entries of one block of a count vector.
BLOCK = 4096


def vector_blocks(vector):
    """(block numbers, blocks as bytes) of a numpy vector of int64 counts, without all-zero blocks."""
    rows = vector.reshape(-1, BLOCK)
    used = rows.any(axis=1).nonzero()[0]
    return used, [rows[k].astype("<i4" if rows[k].max() < 1 << 31 else "<i8").tobytes() for k in used]


def sum_vectors(blocks: DataFrame, size: int):
    """The sum over all tasks of vectors given as (block int, data binary).

    Blocks are dealt by number and added up as they stream in; a task holds the sums only, and the
    driver gets one vector of ``size`` counts, whatever the input.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        sums = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1)):
                raw = data.as_py()
                part = np.frombuffer(raw, "<i4" if len(raw) == 4 * BLOCK else "<i8")
                sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "data"])

    total = np.zeros(size, np.int64)
    for r in blocks.repartition("block").mapInArrow(run, "block int, data binary").collect():
        total[r.block * BLOCK : (r.block + 1) * BLOCK] += np.frombuffer(bytes(r.data), np.int64)
    return total
