"""The dashboard's tables, and the summary document made of them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import exprs as X
from riskweave.operators import eda
from riskweave.operators.metrics import threshold_sweep


def overall(scored: DataFrame, flag: str, label: str) -> DataFrame:
    """Totals, rates, and the recall of the flag (null without positives)."""
    f, y = F.sum(F.col(flag).cast("long")), F.sum(F.col(label).cast("long"))
    caught = F.sum((F.col(flag) * F.col(label)).cast("long"))
    return scored.agg(F.count("*").alias("n_payments"), f.alias("n_flagged"), y.alias("n_excluded"), X.divide(f, F.count("*")).alias("flagged_rate"), X.divide(y, F.count("*")).alias("excluded_rate"), X.divide(caught, y).alias("recall"))


def top_categories(scored: DataFrame, category: Column, flag: str, n: int = 20) -> DataFrame:
    """The most frequent categories (ties by name), with their flagged rates."""
    rates = eda.category_rates(scored, X.missing(category.cast("string")), flag)
    return eda.top(rates, n, F.col("n").desc(), "category")


def flagged(scored: DataFrame, score: str, threshold: float, key: str) -> DataFrame:
    """The three columns of a scoring run."""
    return scored.select(key, F.col(score).alias("predicted_probability"), (F.col(score) >= threshold).cast("int").alias("flagged_for_review"))


def summary(scored: DataFrame, score: str, flag: str, label: str, categories: list[str], models: dict[str, DataFrame] | None = None) -> str:
    """The JSON document: totals, categories, histogram and a threshold sweep for each model; each part is bounded in size.

    models: by name, the scored test rows (columns score and label) of each model; by default scored itself.
    """
    rows = lambda df: [r.asDict() for r in df.collect()]
    parts = {"overall": rows(overall(scored, flag, label))[0], "histogram": rows(eda.histogram(scored, score, 0, 1, 40, flag).orderBy("bin")), "threshold_sweep": {}}
    for name, own in (models or {"model": scored}).items():
        sweep = rows(threshold_sweep(own, score, label).orderBy("threshold"))
        parts["threshold_sweep"][name] = {c: [r[c] for r in sweep] for c in ("threshold", "precision", "recall", "f1")}
    return json.dumps(parts | {c: rows(top_categories(scored, F.col(c), flag)) for c in categories})
