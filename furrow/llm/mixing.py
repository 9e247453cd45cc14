"""Mixing sources to target weights by Poisson replication, in built-in functions only.

A source's mean repetition rate is its target share over its actual share. Each document draws a
uniform number from a hash of its id and the seed, and its count is the inverse of the Poisson
distribution function there: the number of cumulative probabilities that lie at or below it (for a high rate
the sum of several such draws). Documents
are exploded by their count and shuffled globally: dealt and sorted by a hash of id and copy (dealt by the
hash, not by ranges of it, as these would be sampled by a scan of their own).

Defined results: size is the text's UTF-8 bytes plus one, so empty and null texts weigh something; a null
source is a source of its own; equal ids draw equal counts; a target that names a source without
documents is left out and the rest is scaled up; documents of a source without a target go; a long text is a
row like any other; where the table has a column of the copy's or the key's name, theirs gets underscores; the outcome depends on the rows only, not on partitions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let

SEED = "mix-1"
#: Without given targets a source's share is its size to this power (0: equal shares, 1: as it is).
POWER = 0.5
#: Sources whose rates are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Largest mean of one Poisson draw; a higher rate is the sum of several draws of equal means, which is a Poisson number again.
MAX_RATE = 16.0
#: Terms of the distribution: beyond 64 a mean of 16 has a probability under 1e-16.
TERMS = 64


def uniform(key: Column, seed: str, part: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash, another one for each part."""
    more = F.when(part > 0, F.concat(F.lit("#"), part.cast("string")))  # concat_ws leaves nulls out
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), more)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", targets: Mapping[str, float] | None = None, power: float = POWER, scale: float = 1.0) -> DataFrame:
    """(source, size, rate): the mean number of copies that brings each source to its target share of ``scale`` x the whole."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).alias("size"))
    if targets is None:
        share = F.pow(F.col("size").cast("double"), F.lit(power))
    else:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))])[F.col("source")], F.lit(0.0))
    totals = sizes.agg(F.sum("size").alias("whole"), F.sum(share).alias("shares")).first()
    whole, shares = totals.whole or 0, totals.shares or 1.0
    return sizes.select("source", "size", (share / F.lit(shares) * F.lit(float(whole)) * F.lit(scale) / F.col("size")).alias("rate"))


def thresholds(rate: Column) -> Column:
    """The cumulative Poisson probabilities P(count <= k), k = 0..TERMS-1, of one draw."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step)["all"]


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", targets: Mapping[str, float] | None = None,
    power: float = POWER, scale: float = 1.0, seed: str = SEED, copy_col: str = "copy", key_col: str = "mix_key",
) -> DataFrame:
    """Every drawn copy with all columns of its document, its number (from 0) and the key that orders it, in shuffled order."""
    rates = source_rates(docs, source_col=source_col, text_col=text_col, targets=targets, power=power, scale=scale)
    draws = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    copy_col, key_col = free_name(docs, copy_col), free_name(docs, key_col)
    src, parts, cdf, n = (free_name(docs, x) for x in ("rate_source", "rate_parts", "rate_cdf", "rate_count"))
    table = rates.select(F.col("source").alias(src), draws.alias(parts), thresholds(F.col("rate") / draws).alias(cdf))
    table = F.broadcast(table) if rates.count() <= BROADCAST_SOURCES else table

    def one(part: Column) -> Column:
        return let(uniform(F.col(id_col), seed, part), lambda u: F.aggregate(F.col(cdf), F.lit(0), lambda k, c: k + F.when(c <= u, 1).otherwise(0)))

    drawn = F.aggregate(F.sequence(F.lit(0), F.col(parts) - 1), F.lit(0), lambda k, part: k + one(part))
    counted = docs.join(table, F.col(source_col).eqNullSafe(F.col(src))).withColumn(n, drawn).where(F.col(n) > 0)
    copies = counted.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy_col))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy_col).cast("string")))
    return copies.withColumn(key_col, key).repartition(key_col).sortWithinPartitions(key_col)
