"""Choosing files from a catalogue by tokens of their codes, with ranked fallbacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of scenarios that lie in the future; their files are never chosen.
FUTURE = ("SSP126", "SSP245", "SSP370", "SSP585")


def _look(values: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key] if values else F.lit(None).cast("string")


def choose(requests: DataFrame, catalogue: DataFrame, *, future: Sequence[str] = FUTURE, period_names: Mapping[str, str] | None = None, water_names: Mapping[str, str] | None = None) -> DataFrame:
    """``requests`` with code, mapset, water and suffix of the file chosen for each; nulls where none fits.

    A request has id, sets (mapsets, best first), crop (null: any), period (null: any) and waters (tokens, best first). ``catalogue``
    has mapset, code and place (its order in the listing). A file fits if its mapset is asked for, its code names no
    ``future`` scenario and has the crop as a token between dots. Of these the earliest mapset counts; in it files of the period go before all
    others (which serve where it has none), then the first water token that a file has, then the listing's order. The
    suffix names the period asked for and the water token, where they have a name.

    A code is compared once with each distinct crop, period and water token asked for. The first file of each mapset and
    combination of these (or any) is then looked up by equality, so that work grows with requests and files, not with their pairs.
    """
    code, nothing = F.col("code"), F.lit(None).cast("string")
    past = ~F.greatest(F.lit(False), F.lit(False), *[F.upper(code).contains(s) for s in future])
    dot = lambda t: F.concat(F.lit("."), t)
    waters = F.filter(F.coalesce("waters", F.array().cast("array<string>")), F.isnotnull)
    asked = ["crop", "period", "water"]
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    pairs = F.concat(F.array(pair("crop", F.col("crop")), pair("period", F.col("period"))), F.transform(waters, lambda w: pair("water", w)))
    wanted = requests.select(F.explode(pairs).alias("x")).select("x.*").dropna().distinct()
    kind, value = F.col("kind"), F.col("value")
    holds = F.when(kind == "crop", code.contains(F.concat(dot(value), F.lit("."))) | code.endswith(dot(value))).when(kind == "period", code.contains(value)).otherwise(code.contains(dot(value)))
    files = catalogue.where(past & code.isNotNull()).groupBy("mapset", "code").agg(F.min("place").alias("place"))
    held = files.select("code").distinct().join(wanted, holds).groupBy("code").agg(*[F.collect_set(F.when(kind == x, value)).alias(x) for x in asked])
    files = files.join(held, "code", "left")
    for x in asked:
        files = files.withColumn(x, F.explode(F.array_append(F.coalesce(x, F.array().cast("array<string>")), nothing)))  # null: any
    first = files.groupBy("mapset", *asked).agg(F.min(F.struct("place", "code")).alias("f"))
    period = F.col("period")
    tries = (
        requests.select("id", "crop", F.posexplode("sets").alias("set_rank", "mapset"), "period", waters.alias("waters"))
        .withColumn("p", F.explode(F.array(F.struct(F.lit(0).alias("other"), "period"), F.struct(F.when(period.isNull(), 0).otherwise(1).alias("other"), nothing.alias("period")))))
        .select("id", "crop", "set_rank", "mapset", "p.*", F.posexplode(F.array_append("waters", nothing)).alias("last", "water"))
    )
    alike = [tries["mapset"] == first["mapset"], *(tries[x].eqNullSafe(first[x]) for x in asked)]
    chosen = F.struct("set_rank", "other", "last", "f.place", "f.code", tries["mapset"], tries["water"])
    best = tries.join(first, alike).groupBy("id").agg(F.min(chosen).alias("b"))
    out = requests.join(best, "id", "left").select(*[requests[x] for x in requests.columns], F.col("b.code").alias("code"), F.col("b.mapset").alias("mapset"), F.col("b.water").alias("water"))
    parts = [_look(period_names or {}, F.col("period")), _look(water_names or {}, F.col("water"))]
    suffix = F.concat(*[F.coalesce(F.concat(F.lit("_"), x), F.lit("")) for x in parts])
    return out.withColumn("suffix", F.when(F.col("code").isNotNull(), suffix))
