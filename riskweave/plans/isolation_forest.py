"""Isolation forest (Liu, Ting and Zhou, ICDM 2008): trees are grown in parallel, each on its own small sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE, SEED = 100, 256, 42
EULER = 0.5772156649015329


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values."""
    n = np.maximum(np.asarray(n, float), 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, cut, left, right, depth at a leaf) of one tree."""
    most = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple] = []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(())
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(open_):
            nodes[at] = (-1, 0.0, -1, -1, depth + float(expected_depth(len(rows))))
            return at
        f = int(rng.choice(open_))
        cut = float(rng.uniform(low[f], high[f]))
        left = x[rows, f] < cut
        nodes[at] = (f, cut, node(rows[left], depth + 1), node(rows[~left], depth + 1), 0.0)
        return at

    node(np.arange(len(x)), 0)
    return nodes


def fit(df: DataFrame, features: list[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> list:
    """The trees. Each is grown on about sample rows, chosen by hash of key and tree.

    One bounded pool of rows (at most 64 samples' worth, by hash order) is drawn for all trees.
    """
    pool = df.select(key, *(F.col(c).cast("double").alias(c) for c in features)).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(64 * sample).toPandas()[features].to_numpy(float)
    if not len(pool):
        return []
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(pool)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f["id"]:
                rng = np.random.default_rng([seed, int(t)])
                rows = rng.permutation(len(sent.value))[:sample]
                yield pd.DataFrame([(t, i, *n) for i, n in enumerate(grow(sent.value[rows], rng))], columns=["tree", "node", "f", "cut", "l", "r", "depth"])

    found = spark.range(0, trees, 1, min(trees, 16)).mapInPandas(run, "tree long, node long, f int, cut double, l long, r long, depth double").orderBy("tree", "node").toPandas()
    return [(g["f"].to_numpy(), g["cut"].to_numpy(), g["l"].to_numpy(), g["r"].to_numpy(), g["depth"].to_numpy()) for _, g in found.groupby("tree")]


def score(df: DataFrame, forest: list, features: list[str], key: str, *keep: str, sample: int = SAMPLE) -> DataFrame:
    """``key, anomaly_score``: nearer 1 is more anomalous. A fitted forest is small whatever the table's size."""
    sent = df.sparkSession.sparkContext.broadcast(forest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[features].to_numpy(float)
            depth = np.zeros(len(x))
            for f, cut, left, right, leaf in sent.value:
                at = np.zeros(len(x), np.int64)
                while (inner := f[at] >= 0).any():
                    rows = np.flatnonzero(inner)
                    n = at[rows]
                    at[rows] = np.where(x[rows, f[n]] < cut[n], left[n], right[n])
                depth += leaf[at]
            mean = depth / max(1, len(sent.value))
            yield frame[[key, *keep]].assign(anomaly_score=2.0 ** (-mean / max(float(expected_depth(sample)), 1e-9)))

    src = df.select(key, *keep, *(F.col(c).cast("double").alias(c) for c in features))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return src.mapInPandas(run, f"{kinds}, anomaly_score double")
