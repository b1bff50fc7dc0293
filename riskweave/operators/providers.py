"""One row per provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import exprs as X
from riskweave.functions.ranks import first_by


def rollup(payments: DataFrame, natures: list[str] | None = None) -> DataFrame:
    """Counts, sums, exact median and mean shares of each npi, and the shares of the listed natures, in one pass.

    Reads npi, is_excluded, amount, related, third_party and, for shares, nature.
    """
    log, shares = X.log_amount(F.col("amount")), nature_shares(natures or [])
    return payments.groupBy("npi").agg(F.max("is_excluded").alias("is_excluded"), F.count("*").alias("total_payment_count"), X.money(F.col("amount")).alias("total_payment_amount"), F.avg(log).alias("mean_payment_amount_log"), F.median(log).alias("median_payment_amount_log"), F.avg("related").alias("share_related_product"), F.avg("third_party").alias("share_third_party_payment"), *shares)


def check_constant_label(payments: DataFrame, label: str = "is_excluded") -> None:
    """An error if some provider's label varies."""
    mixed = payments.groupBy("npi").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi")
    if not mixed.isEmpty():
        raise ValueError(f"{label} differs between payments of one provider")


def varying(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys whose value isn't the same in all their rows, with the number of values: none if it is encoded consistently."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def mode(payments: DataFrame, value: str, name: str) -> DataFrame:
    """``npi, name, n_values``: the most frequent value (ties: the first by name; null is Missing), and how many it has."""
    counted = payments.groupBy("npi", X.missing(F.col(value)).alias(name)).agg(F.count("*").alias("_n"))
    many = counted.groupBy("npi").agg(F.count("*").alias(f"n_{value}"))
    return first_by(counted, ["npi"], [F.col("_n").desc(), F.col(name)]).drop("_n").join(many, "npi")


def manufacturer_pairs(payments: DataFrame) -> DataFrame:
    return payments.groupBy("npi", "manufacturer").agg(F.count("*").alias("payment_count"), X.money(F.col("amount")).alias("amount"))


def concentration(pairs: DataFrame) -> DataFrame:
    """Manufacturers of each npi and the largest one's share of its money; null where the total is 0."""
    out = pairs.groupBy("npi").agg(F.count("*").alias("n_distinct_manufacturers"), F.max("amount").alias("_top"), X.money(F.col("amount")).alias("_all"))
    return out.select("npi", "n_distinct_manufacturers", X.divide(F.col("_top"), F.col("_all")).alias("top_manufacturer_amount_share"))


def nature_shares(names: list[str], other: str | None = None) -> list[Column]:
    """A share for each name, and, if other is given, one of that name for all the rest, nulls included."""
    rest = [F.avg((~F.coalesce(F.col("nature").isin(names), F.lit(False))).cast("int")).alias(f"share_nature_{other}")] if other else []
    return rest + [F.avg((F.col("nature") == n).cast("int")).alias(f"share_nature_{n}") for n in names]


def nature_mix(payments: DataFrame, names: list[str], other: str | None = None) -> DataFrame:
    """Each listed group's share of an npi's payments, as conditional means of one pass."""
    return payments.groupBy("npi").agg(*nature_shares(names, other))


def provider_features(payments: DataFrame, natures: list[str]) -> DataFrame:
    """The full provider row: rollup, specialty, concentration and mix."""
    parts = [mode(payments, "specialty", "recipient_specialty"), concentration(manufacturer_pairs(payments))]
    out = rollup(payments, natures)
    for p in parts:
        out = out.join(p, "npi")
    return out


def weighted_mean(df: DataFrame, key: str, value: str, weight: str, name: str) -> DataFrame:
    """The weighted mean of each key, the plain one where the weights don't exceed 0."""
    w = F.sum(weight)
    return df.groupBy(key).agg(F.when(w > 0, X.divide(F.sum(F.col(value) * F.col(weight)), w)).otherwise(F.avg(value)).alias(name))
