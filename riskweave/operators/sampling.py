"""Deterministic samples, splits and folds: which rows are taken depends on a key's hash and the seed only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.config import FOLDS, SEED, TEST_SHARE
from riskweave.functions.exprs import portable_hash
from riskweave.functions.ranks import hash_rank


def sample(df: DataFrame, key: str, fraction: float, seed: int = SEED, keep: str | None = None) -> DataFrame:
    """A fraction of the rows, and all rows where the column keep is 1."""
    taken = portable_hash(F.col(key), seed) < int(fraction * 2**32)
    return df.where(taken | (F.col(keep) == 1) if keep else taken)


def exact_negatives(df: DataFrame, key: str, label: str, fraction: float, seed: int = SEED) -> DataFrame:
    """All positives, and exactly round(fraction * n) of the negatives."""
    ranked = hash_rank(df, [label], key, seed)
    return ranked.where((F.col(label) == 1) | (F.col("rn") <= F.floor(F.col("stratum_n") * fraction + 0.5))).drop("rn", "stratum_n")


def stratified_split(df: DataFrame, key: str, label: str, test: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Adds is_test: round(test * n) rows of each label."""
    ranked = hash_rank(df, [label], key, seed)
    return ranked.withColumn("is_test", (F.col("rn") <= F.floor(F.col("stratum_n") * test + 0.5)).cast("int")).drop("rn", "stratum_n")


def with_groups(df: DataFrame, group: str, record: str) -> DataFrame:
    """Adds group_id: the group, or a negative id of its own for a row without one."""
    return df.withColumn("group_id", F.coalesce(F.col(group).cast("long"), -1 - F.col(record).cast("long")))


def group_labels(df: DataFrame, group: str, label: str) -> DataFrame:
    return df.groupBy(group).agg(F.max(label).alias(label))


def group_split(df: DataFrame, group: str, label: str, test: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Adds is_test to rows: whole groups, stratified by their highest label; test is a share of groups."""
    split = stratified_split(group_labels(df, group, label), group, label, test, seed).select(group, "is_test")
    return df.join(split, group)


def folds(df: DataFrame, key: str, label: str, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Adds fold: rows of each label dealt in turn by hash."""
    return hash_rank(df, [label], key, seed).withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn", "stratum_n")


def nested_folds(df: DataFrame, key: str, label: str, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Adds deal, 0 to k * k - 1: fold is deal % k, and ``inner_fold`` gives a row's fold among those without fold i."""
    return hash_rank(df, [label], key, seed).withColumn("deal", ((F.col("rn") - 1) % (k * k)).cast("int")).drop("rn", "stratum_n")


def inner_fold(deal: int, i: int, k: int = FOLDS) -> int | None:
    """The fold that ``folds`` gives a row of this deal when fold i is left out; none if the row is of fold i.

    Rank k * q + f within the label becomes (k - 1) * q + f, less one where f > i.
    """
    q, f = divmod(deal, k)
    return None if f == i else ((k - 1) * q + f - (f > i)) % k


def group_folds(df: DataFrame, group: str, label: str, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Adds fold to rows: whole groups."""
    return df.join(folds(group_labels(df, group, label), group, label, k, seed).select(group, "fold"), group)


def split_stats(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows, providers (groups from 0 on), rows without one (groups below 0), excluded providers and rows, and the rate of each side of is_test."""
    per = df.groupBy("is_test", group).agg(F.count("*").alias("n"), F.sum(label).alias("p"), F.max(label).alias("y"))
    real = F.col(group) >= 0
    count = lambda c: F.coalesce(F.sum(F.when(real, c)), F.lit(0)).cast("long")
    return per.groupBy("is_test").agg(F.sum("n").alias("n_rows"), count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("rows_without_npi"), count(F.col("y")).alias("n_positive_groups"), F.sum("p").alias("n_positive_rows"), F.try_divide(F.sum("p").cast("double"), F.sum("n").cast("double")).alias("positive_rate"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides: none for disjoint splits."""
    return a.select(key).intersect(b.select(key))
