"""How well a classifier tells one country's regions from all others, against shuffled labels.

Every classifier (a target country, a label draw, a fold) is fitted at once: a Newton step needs the sums
of gradient and curvature over the regions, which are added up where the regions lie; coefficients go back
as a broadcast. Labels are never stored. Regions get a rank, those of a country side by side; a draw is a
bijection of the ranks, so a region works out its label and its fold from its own rank. Scores of the
held-out folds become AUCs by running counts over ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d
from furrow.operators import order
from furrow.session import settled

#: Bytes of sums that come to the driver at once, and classifiers and regions that a task weighs at a time.
SUM_BYTES, CHUNK, ROWS = 32 << 20, 256, 2000
#: Newton steps at most, the size of a step that ends them, and the inverse strength of the penalty.
STEPS, SMALL_STEP, STRENGTH = 50, 1e-8, 1.0


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all of the argument's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bijection(at: np.ndarray, size: int, key: int) -> np.ndarray:
    """A permutation of 0..size-1 that depends on ``key``, at the places ``at``: a Feistel network, walked until it lands inside."""
    half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = _mix(np.uint64(key % (1 << 64)) + np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def turn(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        return left << shift | right

    out = turn(np.asarray(at).astype(np.uint64))
    while (outside := out >= size).any():
        out[outside] = turn(out[outside])
    return out.astype(np.int64)


@dataclass
class Fits:
    """The classifiers: a column per target, draw and fold. Ranks of a target are first to first + own - 1 of ``regions``."""

    regions: int
    first: np.ndarray
    own: np.ndarray
    draw: np.ndarray
    fold: np.ndarray
    folds: np.ndarray
    seed: int

    def part(self, at) -> Fits:
        return Fits(self.regions, self.first[at], self.own[at], self.draw[at], self.fold[at], self.folds[at], self.seed)

    def __len__(self) -> int:
        return len(self.draw)

    def labels(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label, whether held out) of each region for each classifier."""
        y, out = np.zeros((2, len(rank), len(self)), bool)
        placed: dict[int, np.ndarray] = {}
        dealt: dict[tuple, tuple] = {}
        for k in range(len(self)):
            b, key = int(self.draw[k]), (int(self.first[k]), int(self.draw[k]), int(self.folds[k]))
            if key not in dealt:
                if b not in placed:
                    placed[b] = bijection(rank, self.regions, self.seed * 1_000_003 + b) if b else rank
                at, first, own = placed[b], int(self.first[k]), int(self.own[k])
                is_own = (at >= first) & (at < first + own)
                inner = np.where(is_own, at - first, np.where(at < first, at, at - own))
                turn = np.where(is_own, bijection(np.where(is_own, inner, 0), own, self.seed), bijection(np.where(is_own, 0, inner), self.regions - own, self.seed + 1))
                dealt[key] = is_own, turn % int(self.folds[k])
            y[:, k] = dealt[key][0]
            out[:, k] = dealt[key][1] == self.fold[k]
        return y, out


def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def _moments(x: np.ndarray, fits: Fits, rank: np.ndarray, at: slice) -> np.ndarray:
    """Of each classifier's training rows: number, own ones, sums and squares of the features."""
    y, out = fits.labels(rank)
    keep = (~out).astype(float)
    return np.concatenate([keep.sum(0)[:, None], (keep * y).sum(0)[:, None], keep.T @ x, keep.T @ (x * x)], axis=1)


@dataclass
class _Slopes:
    """Loss, gradient and curvature of each classifier at its coefficients ``v`` (raw features, the intercept last)."""

    v: np.ndarray
    share: np.ndarray

    def __call__(self, x: np.ndarray, fits: Fits, rank: np.ndarray, at: slice) -> np.ndarray:
        y, out = fits.labels(rank)
        z = np.column_stack([x, np.ones(len(x))])
        s = z @ self.v[at].T
        weight = np.where(out, 0.0, np.where(y, self.share[at, 1], self.share[at, 0]))
        p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        a, b = _pairs(z.shape[1])
        loss = (weight * (np.logaddexp(0, s) - y * s)).sum(0)
        return np.concatenate([loss[:, None], (weight * (p - y)).T @ z, (weight * p * (1 - p)).T @ (z[:, a] * z[:, b])], axis=1)


def _summed(table: DataFrame, fits: Fits, width: int, measure) -> np.ndarray:
    """``measure`` added up over all regions: a row of ``width`` numbers per classifier, ``SUM_BYTES`` at most."""
    chunks = [slice(k, min(k + CHUNK, len(fits))) for k in range(0, len(fits), CHUNK)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(fits), width))
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.iloc[k : k + ROWS]
                x, rank = np.stack(part["x"].to_numpy()), part["rank"].to_numpy()
                for at in chunks:
                    sums[at] += measure(x, fits.part(at), rank, at)
        yield pd.DataFrame({"chunk": range(len(chunks)), "data": [sums[at].tobytes() for at in chunks]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch["chunk"], batch["data"]):
                own = np.frombuffer(data)
                sums[k] = sums[k] + own if k in sums else own
        yield pd.DataFrame({"chunk": list(sums), "data": [v.tobytes() for v in sums.values()]})

    out = np.zeros((len(fits), width))
    for r in table.mapInPandas(run, "chunk int, data binary").repartition("chunk").mapInPandas(add, "chunk int, data binary").collect():
        out[chunks[r.chunk]] = np.frombuffer(bytes(r.data)).reshape(-1, width)
    return out


def fitted(table: DataFrame, fits: Fits, features: int) -> np.ndarray:
    """The coefficients (raw features, the intercept last) of balanced logistic regression with a squared penalty on scaled features.

    All classifiers step together; one whose loss would rise halves its step, one whose step is small enough is done.
    """
    m = _summed(table, fits, 2 + 2 * features, _moments)
    n, ones, total, squares = m[:, 0], m[:, 1], m[:, 2 : 2 + features], m[:, 2 + features :]
    mean = total / n[:, None]
    std = np.sqrt(np.maximum(squares / n[:, None] - mean * mean, 0))
    std = np.where(std > 1e-12 * np.sqrt(squares / n[:, None] + 1e-300), std, 1.0)
    share = np.column_stack([n / (2 * (n - ones)), n / (2 * ones)])
    size = features + 1
    scale = np.zeros((len(fits), size, size))  # raw rows to scaled ones
    scale[:, np.arange(features), np.arange(features)] = 1 / std
    scale[:, np.arange(features), features] = -mean / std
    scale[:, features, features] = 1
    penalty = np.append(np.full(features, 1 / STRENGTH), 0.0)
    a, b = _pairs(size)
    raw = lambda w: np.einsum("kij,ki->kj", scale, w)
    w, step, length = np.zeros((len(fits), size)), np.zeros((len(fits), size)), np.ones(len(fits))
    loss, done = np.full(len(fits), np.inf), np.zeros(len(fits), bool)
    for _ in range(STEPS):
        trial = w - length[:, None] * step
        live = np.flatnonzero(~done)
        s = _summed(table, fits.part(live), 1 + size + len(a), _Slopes(raw(trial)[live], share[live]))
        now = s[:, 0] + (penalty * trial[live] ** 2).sum(1) / 2
        fine = (now <= loss[live] + 1e-12 * np.abs(now)) | (length[live] < 1e-6)
        slope = np.einsum("kij,kj->ki", scale[live], s[:, 1 : 1 + size]) + penalty * trial[live]
        curve = np.zeros((len(live), size, size))
        curve[:, a, b] = curve[:, b, a] = s[:, 1 + size :]
        curve = scale[live] @ curve @ scale[live].transpose(0, 2, 1) + np.diag(penalty + 1e-9)
        fresh = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        took = live[fine]
        moved = np.abs(trial[took] - w[took]).max(1)
        ended = took[(moved < SMALL_STEP) & np.isfinite(loss[took])]
        w[took], loss[took], step[took], length[took] = trial[took], now[fine], fresh[fine], 1.0
        length[live[~fine]] /= 2
        done[ended] = True
        if done.all():
            break
    return raw(w)


def domain_distance(
    regions: DataFrame, features: Sequence[str], *, region: str = "region", country: str = "country", folds: int = 5, least: int = 3, draws: int = 500, alpha: float = 0.05, far: float = 0.25, seed: int = 42
) -> DataFrame:
    """One row per country: n_target, n_pool, auc, auc_std, auc_null_mean, auc_debiased, perm_p, shift_class, n_perm, note.

    ``regions`` has one row per region, of any number; one row per country comes to the driver. Missing features take the column's median; a feature without values
    counts as 0, which tells nothing apart. Draws and folds follow from seed, draw and the rank by a hash of the region, so a lost task repeats the
    same. A country of fewer than ``least`` regions, or with fewer than two regions outside it, is undetermined and says so in the note.
    """
    spark = regions.sparkSession
    named = regions.select(F.col(region).alias("r"), F.col(country).alias("c"), *[F.col(n).cast("double").alias(f"f_{i}") for i, n in enumerate(features)])
    long = named.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"f_{i}").alias("v")) for i in range(len(features))])).alias("x")).select("x.*")
    medians = {r.i: r.m for r in order.percentiles(long, F.col("v"), {"m": 0.5}, by=["i"]).collect()}  # a row a feature
    x = F.array(*[F.coalesce(F.when(~F.isnan(f"f_{i}"), F.col(f"f_{i}")), d(medians.get(i) or 0)) for i in range(len(features))])
    keyed = named.select("c", x.alias("x"), F.struct("c", F.xxhash64("r", F.lit(seed)).alias("h"), "r").alias("key_"), F.lit(1).alias("one"))
    table = settled(order.running(keyed, "key_", ["one"]).select("c", "x", F.col("one_before").cast("long").alias("rank")))
    places = table.groupBy("c").agg(F.min("rank").alias("first"), F.count("*").alias("own")).collect()  # a row a country
    total = sum(r.own for r in places)
    jobs = []
    for i, r in enumerate(places):
        k = min(folds, r.own, total - r.own)
        jobs.append((i, r.c, r.own, total - r.own, k, r.own >= least and k >= 2, r.first))
    able = [j for j in jobs if j[5]]
    fits = Fits(total, *(np.array(v, np.int64) for v in zip(*[(j[6], j[2], b, f, j[4]) for j in able for b in range(draws + 1) for f in range(j[4])])), seed) if able else None
    kind = regions.schema[country].dataType.simpleString()
    sizes = spark.createDataFrame([j[:6] for j in jobs], f"i int, c {kind}, n_target long, n_pool long, k int, able boolean")
    scored = spark.createDataFrame([], "i int, draw int, auc double, std double")
    if fits:
        width = 1 + (len(features) + 1) * (len(features) + 4) // 2
        block = max(CHUNK, SUM_BYTES // (8 * width))
        coef = np.concatenate([fitted(table, fits.part(slice(k, k + block)), len(features)) for k in range(0, len(fits), block)])
        target = np.array([j[0] for j in able for _ in range(draws + 1) for _ in range(j[4])])
        scored = _aucs(table, fits, coef, target)
    # null holds one number per draw, so its size is a parameter
    seen = scored.groupBy("i").agg(
        F.max(F.when(F.col("draw") == 0, F.col("auc"))).alias("auc"), F.max(F.when(F.col("draw") == 0, F.col("std"))).alias("auc_std"), F.collect_list(F.when(F.col("draw") > 0, F.col("auc"))).alias("null"),
    )
    mean = F.aggregate("null", d(0), lambda s, v: s + v) / draws
    p = (F.size(F.filter("null", lambda v: v >= F.col("auc"))) + 1) / d(draws + 1)
    seen = seen.select("i", "auc", "auc_std", mean.alias("auc_null_mean"), (F.col("auc") - mean).alias("auc_debiased"), p.alias("perm_p"))
    note = F.when(~F.col("able"), F.concat(F.lit("too few regions to tell: "), F.col("n_target").cast("string"), F.lit(" in, "), F.col("n_pool").cast("string"), F.lit(" out"))).when(F.col("k") < folds, F.concat(F.lit("folds reduced to "), F.col("k").cast("string"))).otherwise("")
    return sizes.join(F.broadcast(seen), "i", "left").select(
        F.col("c").alias(country), "n_target", "n_pool", "auc", "auc_std", "auc_null_mean", "auc_debiased", "perm_p", c.shift_class(F.col("perm_p"), F.col("auc_debiased"), alpha, far).alias("shift_class"),
        F.when(F.col("able"), draws).otherwise(0).alias("n_perm"), note.alias("note"),
    )


def _aucs(table: DataFrame, fits: Fits, coef: np.ndarray, target: np.ndarray) -> DataFrame:
    """(i, draw, auc, std): mean and deviation over the folds of each target and draw."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.iloc[k : k + ROWS]
                x, rank = np.stack(part["x"].to_numpy()), part["rank"].to_numpy()
                for first in range(0, len(fits), CHUNK):
                    at = slice(first, first + CHUNK)
                    y, out = fits.part(at).labels(rank)
                    row, col = np.nonzero(out)
                    score = (x @ coef[at, :-1].T)[row, col]
                    yield pd.DataFrame({"i": target[at][col], "draw": fits.draw[at][col], "fold": fits.fold[at][col], "score": score.round(9) + 0.0, "event": y[row, col]})

    held = table.mapInPandas(run, "i int, draw int, fold int, score double, event boolean")
    each = order.auc(held, score="score", event="event", by=["i", "draw", "fold"])
    return each.groupBy("i", "draw").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("std"))
