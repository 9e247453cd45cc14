"""The data contract: the rules of one kind over all columns of a table in one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.columns import d


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows beyond the first of each key; null keys are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def numeric_rules(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """(column, non_numeric, below_min, above_max) of text or number columns."""
    aggs = []
    for name, (low, high) in bounds.items():
        v = F.expr(f"try_cast(`{name}` AS double)")
        aggs += [F.count_if(F.col(name).isNotNull() & v.isNull()).alias(f"bad_{name}"), F.count_if(v < low if low is not None else F.lit(False)).alias(f"low_{name}"), F.count_if(v > high if high is not None else F.lit(False)).alias(f"high_{name}")]
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"bad_{n}").alias("non_numeric"), F.col(f"low_{n}").alias("below_min"), F.col(f"high_{n}").alias("above_max")) for n in bounds])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def parse_dates(df: DataFrame, column: str, out: str = "day") -> DataFrame:
    """The column as dates: YYYYMMDD if any value of the whole column parses so, else the general form."""
    compact, general = F.try_to_timestamp(F.col(column), F.lit("yyyyMMdd")).cast("date"), F.expr(f"try_cast(`{column}` AS date)")
    some = df.agg((F.count(compact) > 0).alias("compact_"))
    return df.join(F.broadcast(some)).withColumn(out, F.when(F.col("compact_"), compact).otherwise(general)).drop("compact_")


def check_columns(df: DataFrame, required: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) columns, sorted; no job runs."""
    return sorted(set(required) - set(df.columns)), sorted(set(df.columns) - set(required))


def summary(df: DataFrame, keys: Sequence[str], bounds: Mapping[str, tuple[float | None, float | None]], required: Sequence[str]) -> DataFrame:
    """One row: row_count, duplicate_rows, violations, ok. Missing columns raise before any job."""
    if missing := check_columns(df, required)[0]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rules = numeric_rules(df, bounds).agg(F.sum(F.col("non_numeric") + F.col("below_min") + F.col("above_max")).alias("violations"))
    whole = df.agg(F.count("*").alias("row_count")).join(duplicate_keys(df, keys)).join(rules)  # one row each
    return whole.select("row_count", "duplicate_rows", "violations", ((F.col("row_count") > 0) & (F.col("duplicate_rows") == 0) & (F.col("violations") == 0)).alias("ok"))


def year_overlap(tables: Mapping[str, tuple[DataFrame, str]], base: str = "yield") -> DataFrame:
    """(file, years, overlap, ok): the sorted years of each table (frame, year column) and those it shares with ``base``.

    A table with years but none in common fails; one without years, and every table if ``base`` has none, is not judged.
    """
    found = None
    for name, (df, column) in tables.items():
        years = df.select(F.expr(f"try_cast(`{column}` AS int)").alias("y")).agg(F.array_sort(F.collect_set("y")).alias("years")).select(F.lit(name).alias("file"), "years")
        found = years if found is None else found.unionByName(years)
    ref = found.where(F.col("file") == base).select(F.col("years").alias("ref_"))  # one row of years
    overlap = F.when((F.col("file") != base) & (F.size("ref_") > 0) & (F.size("years") > 0), F.array_intersect("years", "ref_"))
    return found.join(F.broadcast(ref)).select("file", "years", overlap.alias("overlap"), F.coalesce(F.size(overlap) > 0, F.lit(True)).alias("ok"))


def season_order(df: DataFrame, start: str = "sos", end: str = "eos") -> DataFrame:
    """One row: rows whose season ends before it starts (missing or non-numeric bounds are not judged)."""
    a, b = (F.expr(f"try_cast(`{x}` AS double)") for x in (start, end))
    n = F.count_if(b < a)
    return df.agg(n.alias("invalid_rows"), (n == 0).alias("ok"))


def scale_warning(df: DataFrame, preferred: Mapping[str, float]) -> DataFrame:
    """(column, largest, warning): true where all values are numbers and the largest is over the preferred maximum; never an error."""
    v = {x: F.expr(f"try_cast(`{x}` AS double)") for x in preferred}
    aggs = [a for x in preferred for a in (F.max(v[x]).alias(f"max_{x}"), F.count_if(F.col(x).isNotNull() & v[x].isNull()).alias(f"bad_{x}"))]
    over = lambda x: F.coalesce((F.col(f"bad_{x}") == 0) & (F.col(f"max_{x}") > d(preferred[x])), F.lit(False))
    rows = F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"max_{x}").alias("largest"), over(x).alias("warning")) for x in preferred])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
