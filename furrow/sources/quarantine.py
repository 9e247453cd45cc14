"""Readers that lose nothing: rows that don't parse or break a rule go to a side output with their reasons."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from furrow.session import shared_folder

#: Where the reader puts a line that doesn't fit the schema.
CORRUPT = "corrupt_"

#: What a location needs.
POINT_RULES = {
    "no id": lambda: F.trim("adm_id") != "",
    "latitude": lambda: F.col("latitude").between(-90, 90),
    "longitude": lambda: F.col("longitude").between(-180, 180),
}


class Split(NamedTuple):
    """Rows that hold, rows that don't (with ``reasons``), and the counts of one scan: rows, kept, rejected and one per rule."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def read_permissive(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """CSV files as typed columns with ``corrupt_`` (a line that doesn't fit, whole; else null) and the file's name."""
    return spark.read.csv(pattern, header=True, schema=f"{schema}, {CORRUPT} string", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).withColumn("file", F.col("_metadata.file_name"))


def split(rows: DataFrame, rules: Mapping[str, Column], *, folder: str | None = None) -> Split:
    """Rows for which every rule holds, and the others with ``reasons`` (names in order); a rule that is null doesn't hold.

    The rows are read once: both outputs are written together, divided by a flag, to ``folder`` (a new one in the
    shared folder by default), and read from there. A corrupt line has the reason ``malformed`` only.
    """
    checks = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    broken = F.array_compact(F.array(*[F.when(~v, F.lit(k)) for k, v in checks.items()])) if checks else F.array().cast("array<string>")
    if CORRUPT in rows.columns:
        broken = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("malformed"))).otherwise(broken)
    names = ["malformed", *checks] if CORRUPT in rows.columns else list(checks)
    marked = rows.withColumn("reasons", broken).withColumn("held", F.size("reasons") == 0)
    seen = Observation()
    counts = [F.count("*").alias("rows"), F.count_if("held").alias("kept"), F.count_if(~F.col("held")).alias("rejected"), *[F.count_if(F.array_contains("reasons", k)).alias(k) for k in names]]
    target = folder or f"{shared_folder(rows.sparkSession)}/split-{uuid.uuid4().hex}"
    marked.observe(seen, *counts).write.partitionBy("held").parquet(target)
    back = rows.sparkSession.read.schema(marked.schema).parquet(target)
    return Split(back.where("held").drop("reasons", "held", CORRUPT), back.where("NOT held").drop("held"), dict(seen.get))


def read_points(spark: SparkSession, pattern: str) -> Split:
    """Location files (adm_id, latitude, longitude) divided by the rules of a point."""
    return split(read_permissive(spark, pattern, "adm_id string, latitude double, longitude double"), {k: v() for k, v in POINT_RULES.items()})


def first_points(points: DataFrame, order: Column, *, region: str = "adm_id") -> DataFrame:
    """One row per region, the first in ``order``."""
    names = [x for x in points.columns if x != region]
    return points.groupBy(region).agg(F.min_by(F.struct(*names), order).alias("p_")).select(region, "p_.*")


def labelled(points: DataFrame, codes: DataFrame, done: DataFrame | None = None, *, keys: tuple[str, ...] = ("adm_id",), code: str = "code") -> Split:
    """Points with the labels of their sampled code; rows of an earlier run (``done``, same columns) are taken over and not looked up again.

    ``codes`` has a row per known code; a point whose code is null or unknown is rejected.
    """
    fresh = points if done is None else points.join(done.select(*keys), list(keys), "left_anti")
    found = fresh.join(codes.withColumn("known_", F.lit(True)), code, "left")
    out = split(found, {"no code": F.col(code).isNotNull(), "unknown code": F.col(code).isNull() | F.coalesce("known_", F.lit(False))})
    good = out.good.drop("known_")
    return Split(good if done is None else good.unionByName(done.select(*good.columns)), out.bad.drop("known_"), out.counts)
