"""Result tables: which columns are metrics, who a run was, summary rows, process-model scores, pivots and the best checkpoint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d

#: Number columns of a tier's table that are no metrics to compare.
NOT_METRICS = ("timestamp", "run_id", "n", "n_samples", "seed", "picp_nominal", "base_rate_extreme", "agreement_rate", "badyear_0.5sig_events", "badyear_1sig_events", "badyear_0.5sig_base_rate", "badyear_1sig_base_rate")
#: Order of the core metrics in a table; others follow by name.
FIRST = ("r2", "rmse", "nrmse", "mae", "mape", "smape", "mse", "crps", "picp", "pinaw", "winkler", "width", "pinball_q10", "pinball_q50", "pinball_q90")
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def metric_columns(df: DataFrame, keys: Sequence[str] = (), *, others: Sequence[str] = NOT_METRICS) -> list[str]:
    """The number columns that are neither keys nor among ``others``, in the table's order; no job runs."""
    return [n for n, t in df.dtypes if (t in _NUMBERS or t.startswith("decimal")) and n not in keys and n not in others]


def ordered(df: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Columns in report order: identity, core metrics, the rest by name."""
    head = [x for x in identity if x in df.columns]
    core = [x for x in FIRST if x in df.columns and x not in head]
    return df.select(*head, *core, *sorted(x for x in df.columns if x not in head and x not in core))


def run_identities(tables: Sequence[DataFrame], columns: Sequence[str], order: str, *, run: str = "run_id") -> DataFrame:
    """(run, columns): who each run was, by the first table that has it and in it the row that is first in ``order``; a column that a table lacks is null."""
    rows = None
    for k, t in enumerate(tables):
        own = t.where(F.col(run).isNotNull()).select(F.col(run).cast("string").alias(run), F.lit(k).alias("table_"), F.col(order).alias("order_"), *[x for x in columns if x in t.columns])
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    first = rows.groupBy(run).agg(F.min_by(F.struct(*columns), F.struct("table_", "order_")).alias("i"))
    return first.select(run, "i.*")


def with_identity(predictions: DataFrame, identities: DataFrame, *, run: str = "run_id", needs: str = "arm") -> DataFrame:
    """Predictions with their run's identity; rows of unknown runs, or of runs without ``needs``, are left out."""
    keyed = predictions.withColumn(run, F.col(run).cast("string"))
    return keyed.join(identities.where(F.col(needs).isNotNull()), run)


def summary_and_years(scored: DataFrame, identity: Mapping[str, Column], *, year: str = "year") -> tuple[DataFrame, DataFrame]:
    """(summary, by year) of a table with a row per year and one overall (year null), each with the identity in front."""
    tagged = scored.withColumns(dict(identity))
    names = list(identity)
    return ordered(tagged.where(F.col(year).isNull()).drop(year), names), ordered(tagged.where(F.col(year).isNotNull()), [*names[:2], year, *names[2:]])


def process_metrics(rows: DataFrame, by: Sequence[str], *, y: str = "y", p: str = "y_pred", refs: Mapping[str, str] | None = None) -> DataFrame:
    """(by, n, r2, rmse, mae, mse, nrmse, mape, smape, within_*, and rmse and mae of each reference): a process model against observations.

    Only finite pairs count. Percentage errors are in percent and of positive observations only; a tolerance in percent isn't met where
    the observation isn't positive. r2 is null without spread. A reference's errors are of its own finite pairs.
    """
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    both = finite(a) & finite(b)
    a, b = F.when(both, a), F.when(both, b)
    size = F.abs(a - b)
    share = F.when(a > 0, size / a)
    total = F.var_pop(a) * F.count(a)
    rate = lambda x: F.avg(F.when(both, F.when(x, d(1)).otherwise(d(0))))
    out = {
        "n": F.count(a), "r2": F.when(total > 0, 1 - F.sum(size * size) / F.nullif(total, d(0))), "rmse": c.rmse(a, b), "mae": c.mae(a, b), "mse": c.mse(a, b), "nrmse": c.nrmse(a, b),
        "mape": 100 * F.avg(share), "smape": 100 * F.avg(2 * size / (F.abs(a) + F.abs(b) + d(1e-9))),
        **{f"within_{round(100 * t)}pct": rate(F.coalesce(share <= d(t), F.lit(False))) for t in (0.01, 0.05, 0.1, 0.2)}, **{f"within_{str(t).replace('.', 'p')}abs": rate(size <= d(t)) for t in (0.1, 0.5)},
    }
    for k, x in (refs or {}).items():
        r = F.col(x).cast("double")
        own = finite(F.col(y).cast("double")) & finite(r)
        out |= {f"rmse_ref_{k}": c.rmse(F.when(own, F.col(y).cast("double")), F.when(own, r)), f"mae_ref_{k}": c.mae(F.when(own, F.col(y).cast("double")), F.when(own, r))}
    return rows.groupBy(*by).agg(*[v.alias(k) for k, v in out.items()])


def pivot_suffixed(rows: DataFrame, keys: Sequence[str], *, dimension: str, level: str, value: str, dimensions: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """One row per key with a column per dimension and level (``dimension_level``); null where there is no row, the largest of several."""
    pick = lambda a, b: F.max(F.when((F.col(dimension) == a) & (F.col(level) == b), F.col(value)))
    return rows.groupBy(*keys).agg(*[pick(a, b).alias(f"{a}_{b}".lower()) for a in dimensions for b in levels])


def best_checkpoint(files: DataFrame, by: Sequence[str], *, name: str = "name", pattern: str = r"loss=([0-9]+(?:\.[0-9]+)?)") -> DataFrame:
    """(by, name, loss): the file of the least loss in its name, the first by name among equals; names without one don't count."""
    loss = F.expr(f"try_cast(nullif(regexp_extract(`{name}`, r'{pattern}', 1), '') AS double)")
    best = F.min_by(F.struct(name, "loss_"), F.struct("loss_", name))
    return files.withColumn("loss_", loss).where("loss_ IS NOT NULL").groupBy(*by).agg(best.alias("b")).select(*by, F.col("b")[name].alias(name), F.col("b.loss_").alias("loss"))
