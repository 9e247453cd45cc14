"""Year splits without leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed_split(years: DataFrame, *, year: str = "year", test: int = 2, val: int = 1) -> DataFrame:
    """(year, split): the last ``test`` years test, ``val`` before them validate, the rest train.

    ``years`` is a control table of at most thousands of rows.
    """
    table = years.select(year).distinct()
    if table.count() < test + val + 1:
        raise ValueError(f"{test + val + 1} years are needed at least")
    back = F.row_number().over(Window.orderBy(F.desc(year)))
    return table.select(year, F.when(back <= test, "test").when(back <= test + val, "val").otherwise("train").alias("split"))


def walk_forward(years: DataFrame, *, year: str = "year", folds: int = 5) -> DataFrame:
    """(fold, train_end, test_year): expanding training years, one test year a fold."""
    table = years.select(year).distinct()
    back = F.row_number().over(Window.orderBy(F.desc(year)))
    ranked = table.select(F.col(year).alias("test_year"), F.lag(year).over(Window.orderBy(year)).alias("train_end"), back.alias("back")).where(F.col("back") <= folds)
    return ranked.where(F.col("train_end").isNotNull()).select(F.row_number().over(Window.orderBy("test_year")).alias("fold"), "train_end", "test_year")


def later_rows(folds: DataFrame, frame: DataFrame, *, year: str = "year") -> DataFrame:
    """Each fold with the rows of every later year (a fold table is a handful of rows)."""
    return frame.join(F.broadcast(folds), F.col(year) > F.col("train_end"))


def leaking_years(split: DataFrame, *, year: str = "year", lags: int = 3) -> DataFrame:
    """(year, lag_year): test years that serve as lags of later test years."""
    test = split.where("split = 'test'").select(F.col(year).alias("y"))
    steps = test.select(F.col("y").alias(year), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("k")).select(year, (F.col(year) - F.col("k")).alias("lag_year"))
    return steps.join(test, F.col("lag_year") == F.col("y"), "left_semi")


def year_gaps(panel: DataFrame, *, key: str, year: str = "year") -> DataFrame:
    """(key, missing): years between a key's first and last that it lacks, for keys that lack some."""
    seen = panel.groupBy(key).agg(F.min(year).alias("a"), F.max(year).alias("b"), F.collect_set(year).alias("s"))
    return seen.select(key, F.explode(F.array_except(F.sequence("a", "b"), "s")).alias("missing"))
