"""Frequencies of series. A series (one key) is one season or one region's run, so it fits a task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.columns import d


def spectrum(df: DataFrame, keys: Sequence[str], step: str, value: str, length: int) -> DataFrame:
    """(keys, frequency, amplitude) of each series, laid on steps 0 to length - 1; gaps count as 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, at = np.zeros(length), pdf[step].to_numpy()
        inside = (at >= 0) & (at < length)
        x[at[inside]] = np.nan_to_num(pdf[value].to_numpy(float)[inside])
        amplitude = np.abs(np.fft.rfft(x))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "frequency": np.arange(len(amplitude)), "amplitude": amplitude})

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, step, value).groupBy(*keys).applyInPandas(run, f"{kinds}, frequency int, amplitude double")


def top_periods(df: DataFrame, keys: Sequence[str], step: str, value: str, length: int, k: int = 2) -> DataFrame:
    """(frequency, period, amplitude) of the k strongest frequencies of the mean spectrum, the constant left out.

    Series are reduced to a spectrum where they lie; only ``length`` / 2 means are ordered. Ties: the lower frequency.
    """
    mean = spectrum(df, keys, step, value, length).where("frequency > 0").groupBy("frequency").agg(F.round(F.avg("amplitude"), 6).alias("amplitude"))
    best = mean.orderBy(F.desc("amplitude"), "frequency").limit(k)
    return best.select("frequency", F.floor(F.lit(length) / F.col("frequency")).cast("int").alias("period"), "amplitude")


def split_dominant(df: DataFrame, keys: Sequence[str], step: str, value: str, k: int = 3) -> DataFrame:
    """``df``'s keys and step with the part of each series in its k strongest frequencies, and the rest.

    The constant takes part. Steps are taken in order, missing values as 0. Ties: the lower frequency.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(step)
        x = np.nan_to_num(pdf[value].to_numpy(float))
        bins = np.fft.rfft(x)
        bins[np.argsort(-np.abs(bins).round(9), kind="stable")[k:]] = 0
        main = np.fft.irfft(bins, n=len(x))
        return pdf[[*keys, step]].assign(dominant=main, rest=x - main)

    kinds = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in (*keys, step))
    return df.select(*keys, step, value).groupBy(*keys).applyInPandas(run, f"{kinds}, dominant double, rest double")


def channel_correlation(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """(a, b, r) for channels a < b: per series the mean product of standardised values, then its mean over series.

    Values are standardised by the sample deviation plus 1e-8, so r is slightly under the correlation.
    """
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]

    def r(a: str, b: str) -> Column:
        return F.covar_pop(a, b) / ((F.stddev_samp(a) + d(1e-8)) * (F.stddev_samp(b) + d(1e-8)))

    each = df.groupBy(*keys).agg(*[r(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    mean = each.agg(*[F.avg(f"r{i}").alias(f"r{i}") for i in range(len(pairs))])
    return mean.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")
