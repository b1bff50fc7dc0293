"""Exploratory tables: missingness, moments, rates, lifts, histograms, correlations, concentration."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import exprs as X
from riskweave.functions.ranks import quantiles, running


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    counted = df.agg(F.count("*").alias("_n"), *(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns))
    long = counted.unpivot(["_n"], columns, "column_name", "n_null")
    return long.select("column_name", "n_null", X.divide(F.col("n_null") * 100, F.col("_n")).alias("pct_null"))


def moments(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Count, mean, population deviation, least and most of the non-null values of each column and group."""
    long = df.select(by, *(F.col(c).cast("double") for c in columns)).unpivot([by], columns, "feature", "value")
    return long.where("value is not null").groupBy("feature", by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def percentiles(df: DataFrame, column: str, by: str, at: tuple = (0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return quantiles(df, [by], column, list(at)).select(by, *(F.col(f"p{i}").alias(f"p{round(p * 100)}") for i, p in enumerate(at)))


def category_rates(df: DataFrame, category: Column, label: str, name: str = "category") -> DataFrame:
    per = df.groupBy(category.alias(name)).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("n_positive"))
    return per.withColumn("rate", X.divide(F.col("n_positive"), F.col("n")))


def top(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the four cells of two 0/1 columns, and how much of each the other covers."""
    cell = lambda x, y: F.sum(((F.col(a) == x) & (F.col(b) == y)).cast("long"))
    both, only_a, only_b = cell(1, 1), cell(1, 0), cell(0, 1)
    return df.agg(cell(0, 0).alias("neither"), only_a.alias("only_a"), only_b.alias("only_b"), both.alias("both"), X.divide(both * 100, both + only_a).alias("pct_of_a"), X.divide(both * 100, both + only_b).alias("pct_of_b"))


def flag_lift(df: DataFrame, flags: list[str], label: str) -> DataFrame:
    """How much more often each flag is set among positives; infinity where no negative has it."""
    long = df.select(label, *flags).unpivot([label], flags, "flag", "value")
    rate = lambda y: X.divide(F.sum(F.when(F.col(label) == y, F.col("value"))), F.sum((F.col(label) == y).cast("long")))
    return long.groupBy("flag").agg(rate(1).alias("rate_positive"), rate(0).alias("rate_negative")).withColumn("lift", F.when(F.coalesce("rate_negative", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.col("rate_positive") / F.col("rate_negative")))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, flag: str) -> DataFrame:
    """Counts by bin (from 0) and flag on fixed edges; the last bin is closed, values outside fall away, all bins come."""
    at = F.when(F.col(value) == high, F.lit(bins)).otherwise(F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins))).cast("long") - 1
    hit = F.col(flag) == 1
    counted = df.groupBy(at.alias("bin")).agg(F.sum(hit.cast("long")).alias("flagged"), F.sum((~hit).cast("long")).alias("other"))
    return df.sparkSession.range(0, bins, 1, 1).select(F.col("id").alias("bin")).join(counted, "bin", "left").select("bin", (F.col("bin") * ((high - low) / bins) + low).alias("edge"), F.coalesce("flagged", F.lit(0)).alias("flagged"), F.coalesce("other", F.lit(0)).alias("other"))


def density(df: DataFrame, value: str, by: str, bins: int, log: bool = False) -> DataFrame:
    """A histogram over the values' own range, as a density within each group; log: over ln(1 + value)."""
    df = df.withColumn(value, X.log_amount(F.col(value))) if log else df
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or low == high:
        return df.sparkSession.createDataFrame([], f"{by} int, bin long, n long, density double")
    width = (high - low) / bins
    at = F.when(F.col(value) == high, F.lit(bins - 1)).otherwise(F.floor((F.col(value) - low) / width)).cast("long")
    per = df.where(F.col(value).isNotNull()).groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))
    total = per.groupBy(by).agg(F.sum("n").alias("_t"))
    return per.join(total, by).select(by, "bin", "n", (F.col("n") / (F.col("_t") * width)).alias("density"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, over the rows that have both, in one pass."""
    pairs = list(combinations(columns, 2))
    cell = lambda a, b: F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
    out = df.agg(*(cell(a, b).alias(f"{a}~{b}") for a, b in pairs)).unpivot([], [f"{a}~{b}" for a, b in pairs], "pair", "r")
    return out.select(F.split_part("pair", F.lit("~"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("~"), F.lit(2)).alias("b"), "r")


def strong(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    return pairs.where(F.abs("r") >= least).orderBy(F.abs("r").desc(), "a", "b")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of mean ranks."""
    src = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    rank = lambda c: running(src.groupBy(c).agg(F.count("*").alias("n")), [], c, ["n"], descending=False).select(F.col(c).alias(f"_{c}"), (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias(f"r_{c}"))
    ranked = src.join(rank("a"), F.col("a") == F.col("_a")).join(rank("b"), F.col("b") == F.col("_b"))
    return ranked.agg(F.corr("r_a", "r_b").alias("rho"))


def concentration(df: DataFrame, category: str, share: float = 0.9) -> DataFrame:
    """One row: categories, how many (largest first) reach the share of rows, median size, how many have under 100."""
    per = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))
    sizes = running(per.groupBy("n").agg(F.count("*").alias("c"), F.sum("n").alias("rows")), [], "n", ["c", "rows"])
    # categories of one size are alike: of that size as many are counted as stay below the share
    before = F.col("cum_rows") - F.col("rows")
    needed = F.least(F.col("c"), F.greatest(F.lit(0), F.ceil((F.col("all_rows") * share - before) / F.col("n"))))
    return sizes.agg(F.max("all_c").alias("n_categories"), F.sum(needed).alias("n_to_share"), F.expr("percentile(n, 0.5, c)").alias("median_rows"), F.sum(F.when(F.col("n") < 100, F.col("c")).otherwise(0)).alias("n_small"), X.divide(F.sum(F.when(F.col("n") < 100, F.col("rows")).otherwise(0)), F.max("all_rows")).alias("small_share"))


def wilson(positive: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = X.divide(positive, n)
    mid, half = (p + z * z / (2 * n)), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def wilson_rates(rates: DataFrame, overall: Column) -> DataFrame:
    """Adds the interval of each rate, and whether it lies above, below or about the overall rate."""
    low, high = wilson(F.col("n_positive"), F.col("n"))
    out = rates.withColumn("low", low).withColumn("high", high)
    return out.withColumn("verdict", F.when(F.col("low") > overall, "ABOVE").when(F.col("high") < overall, "below").otherwise("~same"))


def size_bands(rates: DataFrame, edges: tuple = (1000, 10_000, 100_000)) -> DataFrame:
    """Categories by size: how far their rates vary, and the share of it beyond what chance explains."""
    band = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        band = F.when(F.col("n") < e, F.lit(i)).otherwise(band)
    src = rates.withColumn("band", band)
    pooled = src.groupBy("band").agg(X.divide(F.sum("n_positive"), F.sum("n")).alias("p"))
    per = src.join(pooled, "band").withColumn("chance", F.col("p") * (1 - F.col("p")) / F.col("n"))
    out = per.groupBy("band").agg(F.count("*").alias("n_categories"), F.max("p").alias("pooled_rate"), F.var_pop("rate").alias("var_observed"), F.avg("chance").alias("var_chance"))
    return out.withColumn("excess_share", X.divide(F.greatest(F.col("var_observed") - F.col("var_chance"), F.lit(0.0)), F.col("var_observed")))


def ordered_bars(rates: DataFrame, highlight: list[str], letters: int = 40) -> DataFrame:
    """Bars of a chart: categories from the highest rate down, with cut labels, and whether each is highlighted."""
    return rates.select(X.truncated(F.col("category"), letters).alias("label"), "n", "rate", F.col("category").isin(highlight).cast("int").alias("highlighted")).orderBy(F.col("rate").desc(), "label")


def spread(rates: DataFrame, n: int = 20) -> DataFrame:
    """One row about the n largest categories: the least and highest rate, their ratio without zero rates, the ratio of
    quartiles, how many lie above, below and about the overall rate (by wilson_rates), and their share of all positives.
    """
    totals = rates.agg(F.sum("n").alias("_n"), F.sum("n_positive").alias("_p"))
    largest = top(rates, n, F.col("n").desc(), "category").crossJoin(totals)  # n rows and one row
    rates = wilson_rates(largest, X.divide(F.col("_p"), F.col("_n")))
    verdicts = [F.sum((F.col("verdict") == v).cast("long")).alias(f"n_{k}") for k, v in (("above", "ABOVE"), ("below", "below"), ("same", "~same"))]
    some = F.when(F.col("rate") > 0, F.col("rate"))
    q = lambda p: F.percentile("rate", F.lit(p))
    return rates.agg(F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"), X.divide(F.max(some), F.min(some)).alias("max_min_ratio"), X.divide(q(0.75), q(0.25)).alias("quartile_ratio"), F.sum("n_positive").alias("n_positive"), *verdicts, X.divide(F.sum("n_positive"), F.max("_p")).alias("share_of_positives"))


def cardinality_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b")).withColumn("ratio", X.divide(F.col("n_a"), F.col("n_b")))


def estimated_train_rows(rates: DataFrame, test: float = 0.2, fraction: float = 0.025) -> DataFrame:
    return rates.withColumn("train_rows", (1 - test) * (F.col("n_positive") + fraction * (F.col("n") - F.col("n_positive"))))
