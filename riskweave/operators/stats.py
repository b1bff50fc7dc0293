"""Standardised rates, Poisson intervals, cross-validation summaries and the paired bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.functions import exprs as X


def standardized_rates(df: DataFrame, group: str, stratum: str, label: str, top: int = 20) -> DataFrame:
    """Observed and expected positives of the largest groups, expected at each stratum's own rate, and their ratio."""
    cells = df.groupBy(X.missing(F.col(group).cast("string")).alias("grp"), X.missing(F.col(stratum).cast("string")).alias("stratum")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    rate = cells.groupBy("stratum").agg(X.divide(F.sum("pos"), F.sum("n")).alias("rate"))
    per = cells.join(rate, "stratum").groupBy("grp").agg(F.sum("n").alias("n"), F.sum("pos").alias("observed"), F.sum(F.col("n") * F.col("rate")).alias("expected"))
    return per.orderBy(F.col("n").desc(), "grp").limit(top).withColumn("smr", X.divide(F.col("observed"), F.col("expected")))


def _poisson_cdf(k: int, mean: float) -> float:
    return 0.0 if k < 0 else sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k + 1)) if mean > 0 else 1.0


def poisson_interval(k: int, level: float = 0.95) -> tuple[float, float]:
    """The exact interval of a Poisson mean, by bisection on the distribution function."""

    def solve(at: int, target: float) -> float:
        low, high = 0.0, k + 20 * math.sqrt(k + 1) + 20
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if _poisson_cdf(at, mid) > target else (low, mid)
        return (low + high) / 2

    tail = (1 - level) / 2
    return (0.0 if k == 0 else solve(k - 1, 1 - tail)), solve(k, tail)


def smr_intervals(rates: DataFrame) -> DataFrame:
    """Adds the exact interval of each ratio, and whether the stratum mix explains it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both = [poisson_interval(int(k)) for k in f["observed"]]
            e = f["expected"].where(f["expected"] > 0)
            low, high = np.array([x for x, _ in both]) / e, np.array([x for _, x in both]) / e
            verdict = np.where(low > 1, "above", np.where(high < 1, "below", "explained by specialty mix"))
            yield f.assign(ci_low=low, ci_high=high, verdict=verdict)

    names = ", ".join(f"{c} {t}" for c, t in rates.dtypes)
    return rates.mapInPandas(run, f"{names}, ci_low double, ci_high double, verdict string")


def paired_bootstrap(df: DataFrame, label: str, a: str, b: str, reps: int = 2000, seed: int = 42, tasks: int = 64) -> DataFrame:
    """One row: the AUC difference of two scores of one test set, its 95% range and how often it isn't positive.

    Both classes are resampled with replacement. The test set (by its nature a small table; at most 5 million rows are
    accepted) is sent to each task, which draws its share of the repetitions.
    """
    size = df.count()
    if size > 5_000_000:
        raise ValueError(f"a bootstrap test set of {size} rows is too large to send to each task")
    held = df.orderBy(label, a, b).select(F.col(label).cast("int").alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).toPandas()
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((held["y"].to_numpy(), held["a"].to_numpy(), held["b"].to_numpy()))

    def auc(y: np.ndarray, s: np.ndarray) -> float:
        _, at, n = np.unique(s, return_inverse=True, return_counts=True)
        rank = (np.cumsum(n) - (n - 1) / 2)[at]
        p = int(y.sum())
        return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p)) if 0 < p < len(y) else float("nan")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x, z = sent.value
        sides = [np.flatnonzero(y == 1), np.flatnonzero(y == 0)]
        for f in frames:
            out = []
            for rep in f["id"]:
                rng = np.random.default_rng([seed, int(rep)])
                at = np.concatenate([rng.choice(s, len(s)) for s in sides if len(s)])
                out.append(auc(y[at], x[at]) - auc(y[at], z[at]))
            yield pd.DataFrame({"d": out})

    draws = spark.range(0, reps, 1, min(tasks, reps)).mapInPandas(run, "d double")
    y, x, z = sent.value
    return draws.agg(F.lit(float(auc(y, x) - auc(y, z))).alias("observed"), F.percentile("d", F.lit(0.025)).alias("ci_low"), F.percentile("d", F.lit(0.975)).alias("ci_high"), F.avg((F.col("d") <= 0).cast("double")).alias("share_not_better"))


def cv_summary(results: DataFrame, config: list[str], metric: str) -> DataFrame:
    """Mean and sample deviation over folds of each configuration."""
    return results.groupBy(*config).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count("*").alias("n_folds"))


def marginal_means(results: DataFrame, axes: list[str], metric: str) -> DataFrame:
    """The mean along each axis of the grid, all axes in one pass."""
    long = results.unpivot([metric], axes, "axis", "value")
    return long.groupBy("axis", "value").agg(F.avg(metric).alias("mean"))


def one_sd_choice(summary: DataFrame, simplest: list) -> DataFrame:
    """The simplest configuration whose mean is within one deviation of the best one's."""
    grid = W.partitionBy()  # a row per configuration
    floor = F.max_by(F.col("mean") - F.col("std"), F.col("mean")).over(grid)
    return summary.withColumn("_floor", floor).where("mean >= _floor").orderBy(*simplest).limit(1).drop("_floor")


def seed_summary(results: DataFrame, variant: str, metrics: list[str]) -> DataFrame:
    """Mean, least and most of each metric over seeds."""
    return results.groupBy(variant).agg(*(f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))


def paired_wins(results: DataFrame, key: str, variant: str, metric: str, a: str, b: str) -> DataFrame:
    """One row: how often a beats b on the same fold or seed, and by how much on average."""
    side = lambda v, n: results.where(F.col(variant) == v).select(key, F.col(metric).alias(n))
    d = side(a, "_a").join(side(b, "_b"), key).withColumn("d", F.col("_a") - F.col("_b"))
    return d.agg(F.count("*").alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("wins"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("std_difference"))
