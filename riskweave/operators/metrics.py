"""Exact ranking metrics. A table of distinct scores is made first; everything else works on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.functions.exprs import divide
from riskweave.functions.ranks import quantiles, running

STEPS = 1000


def score_groups(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """A row per distinct score, with the positives, negatives and rows at and above it."""
    per = df.groupBy(*(by or []), F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    return running(per, by or [], "score", ["pos", "n"])


def average_precision(groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sum of recall steps times precision, over distinct descending scores."""
    step = divide(F.col("pos"), F.col("all_pos")) * divide(F.col("cum_pos"), F.col("cum_n"))
    return groups.groupBy(*(by or [])).agg(F.sum(step).alias("average_precision"))


def roc_auc(groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The share of (positive, negative) pairs in order, ties as half; null with one class."""
    neg, all_neg = F.col("n") - F.col("pos"), F.col("all_n") - F.col("all_pos")
    below = all_neg - (F.col("cum_n") - F.col("cum_pos"))
    return groups.groupBy(*(by or [])).agg(divide(F.sum(F.col("pos") * (below + neg / 2.0)), F.max(F.col("all_pos") * all_neg)).alias("roc_auc"))


def summary(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """AP, AUC, the positive rate and AP over it, in one pass over the score groups."""
    groups = score_groups(df, score, label, by)
    neg, all_neg = F.col("n") - F.col("pos"), F.col("all_n") - F.col("all_pos")
    below = all_neg - (F.col("cum_n") - F.col("cum_pos"))
    ap = F.sum(divide(F.col("pos"), F.col("all_pos")) * divide(F.col("cum_pos"), F.col("cum_n")))
    auc = divide(F.sum(F.col("pos") * (below + neg / 2.0)), F.max(F.col("all_pos") * all_neg))
    rate = divide(F.max("all_pos"), F.max("all_n"))
    return groups.groupBy(*(by or [])).agg(ap.alias("average_precision"), auc.alias("roc_auc"), rate.alias("positive_rate"), divide(ap, rate).alias("lift"))


def pr_curve(groups: DataFrame) -> DataFrame:
    return groups.select("score", divide(F.col("cum_pos"), F.col("cum_n")).alias("precision"), divide(F.col("cum_pos"), F.col("all_pos")).alias("recall"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1, 0 where they are undefined."""
    zero = lambda a, b: F.coalesce(divide(a, b), F.lit(0.0))
    return [zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1")]


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: tn, fp, fn, tp, and what follows from them; a score equal to the threshold is positive."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    cells = df.agg(count(~hit & ~y).alias("tn"), count(hit & ~y).alias("fp"), count(~hit & y).alias("fn"), count(hit & y).alias("tp"))
    return cells.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_sweep(df: DataFrame, score: str, label: str, steps: int = STEPS) -> DataFrame:
    """Metrics at each threshold k / steps, for score >= threshold; rows are counted by step before any window."""
    guess = F.floor(F.col(score) * steps)
    k = F.when(F.col(score) < guess / float(steps), guess - 1).when(F.col(score) >= (guess + 1) / float(steps), guess + 1).otherwise(guess)
    per = df.where(F.col(score).isNotNull()).groupBy(F.greatest(F.lit(-1), F.least(F.lit(steps), k)).alias("k")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.range(-1, steps + 1, 1, 1).select(F.col("id").alias("k")).join(per, "k", "left").select("k", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("n", F.lit(0)).alias("n"))
    down = W.orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)  # steps + 2 rows
    out = grid.select("k", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("hits"), F.sum("pos").over(W.partitionBy()).alias("p"))
    tp, fp, fn = F.col("tp"), F.col("hits") - F.col("tp"), F.col("p") - F.col("tp")
    return out.where("k >= 0").select((F.col("k") / float(steps)).alias("threshold"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), *prf(tp, fp, fn))


def selections(sweep: DataFrame, recall_floor: float = 0.8, precision_floor: float = 0.5) -> DataFrame:
    """The best F1, the best precision at a recall floor, the best recall at a precision floor; ties: lowest threshold."""
    pick = lambda df, c, name: df.orderBy(F.col(c).desc(), "threshold").limit(1).select(F.lit(name).alias("selection"), "threshold", "precision", "recall", "f1")
    return pick(sweep, "f1", "best_f1").unionByName(pick(sweep.where(F.col("recall") >= recall_floor), "precision", "best_precision")).unionByName(pick(sweep.where(F.col("precision") >= precision_floor), "recall", "best_recall"))


def nearest_threshold(sweep: DataFrame, value: float) -> DataFrame:
    return sweep.orderBy(F.abs(F.col("threshold") - value), "threshold").limit(1)


def percentile_ranks(df: DataFrame, score: str) -> DataFrame:
    """``score, n, pct_rank``: the mean rank of each distinct score as a percentage of all rows."""
    per = running(df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n")), [], "score", ["n"], descending=False)
    return per.select("score", "n", ((F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0) / F.col("all_n") * 100).alias("pct_rank"))


def anomaly_capture(df: DataFrame, score: str, label: str, shares: tuple = (0.01, 0.05, 0.10)) -> DataFrame:
    """How highly positives rank: mean score and percentile rank of either class, and positives above each cutoff, with their share of all."""
    found = quantiles(df, [], score, [1 - s for s in shares]).first()
    cuts = list(found) if found else [None] * len(shares)
    ranked = df.join(percentile_ranks(df, score).select(F.col("score").alias("_s"), "pct_rank"), F.col(score) == F.col("_s"))
    y = F.col(label) == 1
    hits = [F.coalesce(F.sum((y & (F.col(score) >= F.lit(c))).cast("long")), F.lit(0)) for c in cuts]
    caught = [x for s, h in zip(shares, hits, strict=True) for x in (h.alias(f"top_{round(s * 100)}_captured"), divide(h, F.sum(y.cast("long"))).alias(f"top_{round(s * 100)}_capture_rate"))]
    mean = lambda c, when: F.avg(F.when(when, F.col(c)))
    return ranked.agg(F.sum(y.cast("long")).alias("n_positive"), mean(score, y).alias("mean_score_positive"), mean(score, ~y).alias("mean_score_negative"), mean("pct_rank", y).alias("mean_rank_positive"), mean("pct_rank", ~y).alias("mean_rank_negative"), *caught)


def unpivoted(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Each of the features that df has, as a score of its own: feature, score, label."""
    found = [c for c in features if c in df.columns]
    return df.select(label, *(F.col(c).cast("double") for c in found)).unpivot([label], found, "feature", "score").where("score is not null")


def single_feature_baselines(df: DataFrame, features: list[str], label: str, full_auc: float | None = None) -> DataFrame:
    """Each feature as a score; with full_auc also whether its AUC beats the full model's."""
    out = summary(unpivoted(df, features, label), "score", label, ["feature"])
    return out if full_auc is None else out.withColumn("beats_full_model_roc", F.coalesce(F.col("roc_auc") > full_auc, F.lit(False)))


def memorization_gap(train: DataFrame, test: DataFrame, score: str, label: str) -> DataFrame:
    """AP on the training side over AP on the test side."""
    both = train.select(score, label, F.lit("train").alias("side")).unionByName(test.select(score, label, F.lit("test").alias("side")))
    ap = average_precision(score_groups(both, score, label, ["side"]), ["side"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("average_precision")))
    return ap.agg(side("train").alias("train_ap"), side("test").alias("test_ap"), divide(side("train"), side("test")).alias("ap_ratio"))


def reproduction_gap(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Rows compared, rows that one side lacks, and the largest difference."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full")
    return both.agg(F.count("*").alias("n"), F.sum((F.col("_a").isNull() | F.col("_b").isNull()).cast("long")).alias("n_unmatched"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"))
