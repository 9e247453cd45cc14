"""Contract readers, prediction files, and a keyed result store."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.comparison import upsert

_SERIES = {"meteo": "tmin tmax prec rad tavg cwb", "fpar": "fpar", "ndvi": "ndvi", "soil_moisture": "ssm"}
#: Required columns of each input table.
REQUIRED = {
    "yield": ["adm_id", "harvest_year", "yield"], "soil": ["adm_id", "awc", "bulk_density"], "crop_calendar": ["adm_id", "sos", "eos"], "location": ["adm_id", "latitude", "longitude"],
    **{k: ["adm_id", "date", *v.split()] for k, v in _SERIES.items()},
}


def read_contract(spark: SparkSession, root: str, table: str, crop: str, country: str) -> DataFrame:
    """One input file as text columns (the contract's rules judge them), with crop and country."""
    df = spark.read.csv(f"{root}/{crop}/{country}/{table}_{crop}_{country}.csv", header=True)
    return df.withColumns({"crop": F.lit(crop), "country": F.lit(country)})


def typed(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Number columns as doubles, what isn't a number (NaN too) as null."""
    clean = lambda n: F.expr(f"nullif(try_cast(`{n}` AS double), double('NaN'))")
    return df.withColumns({n: clean(n) for n in numbers})


def read_predictions(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Prediction files by a glob, malformed lines dropped, with the file's name."""
    return spark.read.csv(pattern, header=True, schema=schema, mode="DROPMALFORMED").withColumn("file", F.col("_metadata.file_name"))


def year_index(spark: SparkSession, path: str, least: int = 8) -> DataFrame:
    """(crop, country, years) of countries with enough years, from a nested JSON object."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,array<int>>>")).alias("crop", "c"))
    return rows.select("crop", F.explode("c").alias("country", "years")).where(F.size("years") >= least)


def new_keys_only(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key a resume log doesn't have yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def merge_into(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], stamp: str = "timestamp", *, published: str | None = None) -> str:
    """Upsert into a Parquet table; the merged table is a new version folder under ``path``, whose path is returned.

    ``published`` is the version folder that counts now (none: the table is new). Runs never overwrite what
    others read, and superseded versions are never read again; the caller publishes the version it wants.
    """
    target = f"{path}/v-{uuid.uuid4().hex}"
    old = spark.read.parquet(published) if published else new.limit(0)
    upsert(old, new, keys, stamp).write.parquet(target)
    return target


def geojson_features(df: DataFrame, properties: Sequence[str], *, lon: str = "longitude", lat: str = "latitude", label: str | None = None) -> DataFrame:
    """(feature): one GeoJSON point per row as text; rows whose ``label`` is null are dropped, null properties are written."""
    rows = df.where(F.col(label).isNotNull()) if label else df
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    whole = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson(df: DataFrame, path: str, properties: Sequence[str], *, name: str = "labels", per_file: int = 100_000, **columns: str | None) -> None:
    """The rows as feature collections, one a line, of about ``per_file`` features each; one collection if they fit it."""
    features = geojson_features(df, properties, **columns)
    parts = max(1, -(-features.count() // per_file))
    dealt = features.groupBy(F.pmod(F.xxhash64("feature", F.monotonically_increasing_id()), F.lit(parts)).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("f"))
    head = f'{{"type":"FeatureCollection","name":{json.dumps(name)},"features":['
    dealt.select(F.concat(F.lit(head), "f", F.lit("]}")).alias("value")).write.mode("errorifexists").text(path)
