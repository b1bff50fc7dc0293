"""Connected components of an edge table, without collecting it anywhere.

Alternating large-star and small-star contraction (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Before each round every partition contracts the edges it happens to hold, so that a round
starts from forests. Minima are aggregated map-side and joined back, so a hub's edges are never brought to one
task: the join is a plain inner equi-join, which adaptive execution splits where a hub is hot. Once fewer than BLOCK
edges are left (a fixed bound, some 8 MB), one task contracts them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import Scratch, local_roots

EDGES = "u long, v long"
#: Edges that a task contracts at a time.
BLOCK = 1 << 19


def contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace each block of edges by a star forest with the same components."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def out() -> pd.DataFrame:
        u, v = local_roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pd.DataFrame({"u": u, "v": v})

    for f in frames:
        held.append((f["u"].to_numpy(np.int64), f["v"].to_numpy(np.int64)))
        rows += len(f)
        if rows >= BLOCK:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60, block: int = BLOCK) -> DataFrame:
    """``node long, component long`` for every node with an edge to another one; component: its smallest node.

    ``edges`` has two long columns u and v. Self-loops, repeated edges and both directions are allowed; rows with
    a null end are ignored; no edges give an empty table. The result is a written table.
    """
    spark = edges.sparkSession
    now = scratch.keep(edges.where("u <> v").mapInPandas(contract, EDGES).distinct())
    mark = None
    for _ in range(rounds):
        tight = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if tight == mark:
            break
        if tight[0] < block:  # what one task may contract at once
            last, now = now, scratch.keep(now.coalesce(1).mapInPandas(contract, EDGES))
            scratch.drop(last)
            break
        mark = tight
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        stars = small.select("u", F.col("m").alias("v")).unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        last, now = now, scratch.keep(stars.distinct())
        scratch.drop(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return spark.read.schema(EDGES).parquet(now._scratch_path).select(F.col("u").alias("node"), F.col("v").alias("component"))
