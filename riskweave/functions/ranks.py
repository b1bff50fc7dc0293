"""Ranks and running totals over a whole table, without a window that sees all of it.

Rows are put in ordered buckets; a small table of bucket totals gives each bucket its offset, and windows only span
one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.functions.exprs import portable_hash

BUCKETS = 256


def hash_rank(df: DataFrame, strata: list[str], key: str, seed: int = 42, name: str = "rn") -> DataFrame:
    """Adds the row number within strata by (portable hash of key, key), and ``stratum_n``, the stratum's rows."""
    shift = 32 - (BUCKETS.bit_length() - 1)
    src = df.withColumn("_h", portable_hash(F.col(key), seed)).withColumn("_b", F.shiftright("_h", shift)).withColumn("_one", F.lit(1))
    by = ["_one", *strata]
    totals = src.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("stratum_n", F.sum("_n").over(W.partitionBy(*by))).drop("_n")
    local = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h", key))
    return src.withColumn("_r", local).join(totals, [*by, "_b"]).withColumn(name, F.col("_r") + F.col("_before")).select(*df.columns, name, "stratum_n")


def running(df: DataFrame, by: list[str], order: str, sums: list[str], descending: bool = True) -> DataFrame:
    """Adds ``cum_<s>`` (up to and with the row) and ``all_<s>`` for each column of sums.

    df has one row for each value of order within by. Bucket bounds are approximate quantiles; the sums are exact.
    """
    src = df.withColumn("_one", F.lit(1))
    keys = ["_one", *by]
    probs = F.array(*(F.lit(i / BUCKETS) for i in range(1, BUCKETS)))
    bounds = src.groupBy(*keys).agg(F.percentile_approx(order, probs, F.lit(4 * BUCKETS)).alias("_bounds"))
    src = src.join(bounds, keys).withColumn("_b", _at_most("_bounds", F.col(order))).drop("_bounds")
    way = (lambda c: F.col(c).desc()) if descending else F.col
    totals = src.groupBy(*keys, "_b").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    before = W.partitionBy(*keys).orderBy(way("_b")).rowsBetween(W.unboundedPreceding, -1)
    for s in sums:
        totals = totals.withColumn(f"_p_{s}", F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0))).withColumn(f"all_{s}", F.sum(f"_t_{s}").over(W.partitionBy(*keys)))
    totals = totals.drop(*(f"_t_{s}" for s in sums))
    upto = W.partitionBy(*keys, "_b").orderBy(way(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = src.select("*", *(F.sum(s).over(upto).alias(f"_c_{s}") for s in sums)).join(totals, [*keys, "_b"])
    return out.select(*df.columns, *((F.col(f"_c_{s}") + F.col(f"_p_{s}")).alias(f"cum_{s}") for s in sums), *(f"all_{s}" for s in sums))


def _at_most(bounds: str, value: Column) -> Column:
    """How many of an ascending array's numbers (fewer than BUCKETS) are at most value, by binary search."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(BUCKETS.bit_length() - 1))))
    fits = lambda at, step: (at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """``*by, p0, p1, ...``: exact quantiles of the non-null values, linearly interpolated.

    Distinct values are counted and ranked by ``running``; each quantile lies at or between two ranks.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running(per, by, "_v", ["_n"], descending=False)
    out = []
    for i, p in enumerate(probs):
        at = (F.col("all__n") - 1) * F.lit(float(p))
        # 0-based ranks of this value: cum - n to cum - 1
        holds = lambda rank: (rank >= F.col("cum__n") - F.col("_n")) & (rank < F.col("cum__n"))
        low, high = (F.max(F.when(holds(f(at)), F.col("_v"))) for f in (F.floor, F.ceil))
        share = F.max(at - F.floor(at))
        out.append((low + F.when(share > 0, (high - low) * share).otherwise(0.0)).alias(f"p{i}"))
    return ranked.groupBy(*by).agg(*out)


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")
