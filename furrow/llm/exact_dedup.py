"""Exact deduplication by two-pass Bloom filtering, in built-in functions only.

Pass one hashes every normalised text to two slots of a bit field sized by the row count, counts rows
per slot (partial counts before the shuffle) and keeps, as 4 KB bitmaps, the slots that two or more
rows hit. Pass two scans again: a row whose two slots are both set is possibly repeated; only its id
and digest shuffle. All other rows are certainly alone and pass straight through.

Group sizes are counted with partial counts; rows of hot groups then meet their group in a broadcast of
fewer than ``HOT_SHARE`` rows, and only the others are dealt by their digest.

Defined results: null counts as the empty text; the largest id of a group stays, a null id only if
there is no other; of rows that also repeat the id exactly one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bitmaps, cut, field_bits, free_name, has_bit

BITS_PER_ROW = 16
#: A group of more than one in so many rows is hot; there are fewer such groups than this, so they are broadcast.
HOT_SHARE = 4096


def _slots(text: Column, bits: int) -> tuple[Column, Column]:
    """Two slots out of the two halves of a 64-bit hash."""
    h = F.xxhash64(text)
    return h.bitwiseAND(F.lit(bits - 1)), F.xxhash64(h, F.lit(1)).bitwiseAND(F.lit(bits - 1))


def repeated_slots(texts: DataFrame, text_col: str, bits: int) -> DataFrame:
    """(bucket, bitmap) of the slots that two or more rows hit."""
    a, b = _slots(F.col(text_col), bits)
    slots = texts.select(F.explode(F.array(a, b)).alias("slot"))
    return bitmaps(slots.groupBy("slot").count().where("count > 1"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, hot_share: int = HOT_SHARE) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("t"))
    total = docs.count()
    bits = bits or field_bits(total, BITS_PER_ROW)
    field = cut(repeated_slots(texts, "t", bits))
    one, two = _slots(F.col("t"), bits)
    rows = texts.select("id", F.sha2("t", 256).alias("sha"), one.alias("s1"), two.alias("s2"), F.monotonically_increasing_id().alias("row"))
    for k in ("1", "2"):
        side = field.select(F.col("bucket").alias(f"b{k}"), F.col("bitmap").alias(f"m{k}"))
        rows = rows.join(F.broadcast(side), F.shiftright(f"s{k}", 15) == F.col(f"b{k}"), "left")
    # bits are set or not whatever the bucket: the field is bits / 8 bytes at most
    marked = cut(rows.select("id", "sha", "row", (has_bit(F.col("m1"), F.col("s1")) & has_bit(F.col("m2"), F.col("s2"))).alias("maybe")))
    alone = marked.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    maybe = marked.where("maybe").select("id", "sha", "row")
    order = F.struct(F.col("id").isNotNull().alias("given"), F.col("id"), F.col("row"))
    groups = cut(maybe.groupBy("sha").agg(F.max(order).alias("k"), F.count("*").alias("group_size")))
    is_hot = F.col("group_size") * hot_share > total
    hot, cool = F.broadcast(groups.where(is_hot)), groups.where(~is_hot)
    both = maybe.join(hot, "sha").unionByName(maybe.join(hot.select("sha"), "sha", "left_anti").join(cool, "sha"))
    met = both.select("id", F.col("k.id").alias("keep_id"), "group_size", (F.col("row") == F.col("k.row")).alias("kept"), "sha")
    return alone.unionByName(met).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept document of each group, with all its columns. Rows that share an id stay or go together."""
    key = free_name(docs, "kept_id")
    kept = exact_duplicates(docs, id_col=id_col, text_col=text_col).where("kept").select(F.col(id_col).alias(key)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
