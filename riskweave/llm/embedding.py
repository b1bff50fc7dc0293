"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them.

All vectors start in one cell a dimension. A cell of more than SPLIT vectors is split by spherical k-means, and so are
its parts, until cells are small: their number grows with the rows, not the work a vector takes. Centres are fitted on
a bounded sample of the cell, on directions from the sample's mean, so that a direction that all vectors share doesn't
matter. A vector goes to its nearest parts, at most PROBES of them, so that close pairs share one. A split is taken only
if it holds the links of the sample together: of its own links and of pairs made to lie just at the limit (see keeps);
fewer parts are tried then, and a group too dense to be parted stays one cell.

A cell is dealt to blocks of BLOCK_NUMBERS numbers, and a task multiplies two blocks. A pair that shares several cells
counts in the first of them only. Tasks emit link counts and star forests, never pairs; copies of one vector are one row
with a count. Recall against brute force is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import Scratch, load, local_roots
from riskweave.llm.components import components

COSINE = 0.95
#: Vectors of a cell that is split, vectors aimed at in a part, most parts, vectors (and numbers) of a sample, rounds, levels.
SPLIT, CELL, FANOUT, SAMPLE_ROWS, SAMPLE_NUMBERS, ROUNDS, LEVELS, SEED = 4000, 1500, 256, 8192, 2_000_000, 10, 6, 42
#: Parts that a vector goes to; shares of the sample's links, and of made pairs at the limit, that have to stay together.
PROBES, HELD, HELD_AT_LIMIT = 4, 0.97, 0.93
#: Numbers of a block that is multiplied, and of a chunk that is placed.
BLOCK_NUMBERS = 1 << 18


def unit(vectors: pd.Series | list) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows."""
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Directions from the mean; rows at the mean itself stay zero."""
    x = x - mean
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size < 1e-12, 1.0, size)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k unit centres of unit rows; an empty cell takes the row that is worst placed."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = x @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        worst = iter(np.argsort(near[np.arange(len(x)), own], kind="stable"))
        for c in np.flatnonzero(size < 1e-12):
            sums[c] = x[next(worst)]
            size[c] = max(1.0, np.sqrt((sums[c] * sums[c]).sum()))
        centres = sums / size[:, None]
    return centres


def nearest(x: np.ndarray, mean: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """For each unit row its nearest parts, nearest first."""
    near = directions(x, mean) @ centres.T
    p = min(probes, near.shape[1])
    at = np.argpartition(-near, p - 1, axis=1)[:, :p]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, axis=1), axis=1, kind="stable"), axis=1)


def limit_pairs(x: np.ndarray, least: float, most: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Rows and made partners at a cosine of just least, each turned towards where another row lies."""
    rng = np.random.default_rng(SEED)
    a = x[rng.permutation(len(x))[:most]]
    u = x[rng.integers(0, len(x), len(a))] - x[rng.integers(0, len(x), len(a))]
    u -= (u * a).sum(axis=1, keepdims=True) * a
    size = np.sqrt((u * u).sum(axis=1))
    a, u = a[size > 1e-9], u[size > 1e-9] / size[size > 1e-9, None]
    return a, least * a + np.sqrt(1 - least * least) * u


def together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two lists of parts have one in common."""
    return (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))


def fit(x: np.ndarray, rows: int, least: float, cell: int, fanout: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Mean, centres and probes of a split of a cell of so many rows, of which the unit rows x are a sample; or none that holds."""
    mean = x.mean(axis=0)
    d = directions(x, mean)
    some = x[: 4096]
    a, b = np.nonzero(np.triu(some @ some.T >= least, 1))
    if len(a) > 20_000:
        pick = np.random.default_rng(SEED).permutation(len(a))[:20_000]
        a, b = a[pick], b[pick]
    at_limit = limit_pairs(x, least)
    k = min(fanout, -(-rows // cell), len(x) // 8)
    while k > 1:
        centres = spherical_kmeans(d, k)
        for probes in range(1, min(PROBES, k - 1) + 1):
            own = nearest(some, mean, centres, probes)
            held = together(own[a], own[b]).mean() if len(a) else 1.0
            if held >= HELD and together(*(nearest(y, mean, centres, probes) for y in at_limit)).mean() >= HELD_AT_LIMIT:
                return mean, centres, probes
        k //= 4
    return None


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id long, v array<double>``: v is null for vectors that can link with nothing."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)), v).alias("v"))


FITS = "d int, cell long, mean binary, centres binary, probes int"


def _fit(least: float, cell: int, fanout: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node")
        found = fit(unit(f["v"]), int(f["rows"].iloc[0]), least, cell, fanout)
        own = [] if found is None else [(f["d"].iloc[0], f["cell"].iloc[0], found[0].tobytes(), found[1].tobytes(), found[2])]
        return pd.DataFrame(own, columns=["d", "cell", "mean", "centres", "probes"])

    return run


def _place(fanout: int):
    def run(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(fits):
            return rows.iloc[:0][["node", "n", "v", "d", "cell"]]
        mean = np.frombuffer(fits["mean"].iloc[0])
        own = nearest(unit(rows["v"]), mean, np.frombuffer(fits["centres"].iloc[0]).reshape(-1, len(mean)), int(fits["probes"].iloc[0]))
        out = rows.loc[rows.index.repeat(own.shape[1]), ["node", "n", "v", "d", "cell"]]
        return out.assign(cell=out["cell"].to_numpy() * (fanout + 1) + 1 + own.ravel())

    return run


def in_cells(distinct: DataFrame, scratch: Scratch, least: float, split: int, cell: int, fanout: int) -> DataFrame:
    """``node, n, v, d, cell, cells``: each distinct vector in each of its cells, with all of them."""
    now = distinct.select("node", "n", "v", F.size("v").alias("d"), F.lit(0).cast("long").alias("cell"))
    done = []
    for level in range(LEVELS):
        large = scratch.keep(now.groupBy("d", "cell").agg(F.count("*").alias("rows")).where(F.col("rows") > split))
        if large.isEmpty():
            break
        known = now.join(large, ["d", "cell"])
        size = F.least(F.lit(SAMPLE_ROWS), F.lit(SAMPLE_NUMBERS) / F.col("d"))
        sample = known.where(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) < size / F.col("rows") * (1 << 30))
        fits = scratch.keep(sample.groupBy("d", "cell").applyInPandas(_fit(least, cell, fanout), FITS))
        # cells and their fits are dealt to chunks of bounded size
        chunks = F.ceil(F.col("rows") * F.col("d") / BLOCK_NUMBERS)
        taken = fits.join(large, ["d", "cell"]).withColumn("chunks", chunks)
        rows = known.join(fits.select("d", "cell"), ["d", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("node"), chunks))
        dealt = taken.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        key = ["d", "cell", "chunk"]
        parts = rows.groupBy(*key).cogroup(dealt.select(*key, "mean", "centres", "probes").groupBy(*key)).applyInPandas(_place(fanout), "node long, n long, v array<double>, d int, cell long")
        done.append(now.join(fits.select("d", "cell"), ["d", "cell"], "left_anti"))
        now = scratch.keep(parts)
        if now.isEmpty():
            break
    out = now
    for x in done:
        out = out.unionByName(x)
    out = scratch.keep(out)
    cells = out.groupBy("node").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    return out.join(cells, "node")


def _first_shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The least cell that both lists of each pair have."""
    return np.array([np.intersect1d(x, y)[0] if len(x) > 1 and len(y) > 1 else (x if len(x) == 1 else y)[0] for x, y in zip(a, b, strict=True)], np.int64)


def _multiply(least: float):
    def group(f: pd.DataFrame) -> tuple[np.ndarray, ...]:
        cell, same = int(f["cell"].iloc[0]), int(f["i"].iloc[0]) == int(f["j"].iloc[0])
        x, node, n = unit(f["v"]), f["node"].to_numpy(np.int64), f["n"].to_numpy(np.int64)
        places = f["cells"].to_numpy()
        several = np.array([len(p) > 1 for p in places])
        left = np.arange(len(f)) if same else np.flatnonzero(f["side"].to_numpy() == 0)
        right = left if same else np.flatnonzero(f["side"].to_numpy() == 1)
        counts, u, v = np.zeros(len(f), np.int64), node[:0], node[:0]
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            a, b = np.nonzero(x[rows] @ x[right].T >= least)
            a, b = rows[a], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            ok = np.ones(len(a), bool)
            both = np.flatnonzero(several[a] & several[b])
            ok[both] = _first_shared(places[a[both]], places[b[both]]) == cell
            a, b = a[ok], b[ok]
            np.add.at(counts, a, n[b])
            np.add.at(counts, b, n[a])
            u, v = local_roots(np.concatenate([u, node[a]]), np.concatenate([v, node[b]]))
        return node[counts > 0], counts[counts > 0], u, v

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _groups(frames, ["d", "cell", "i", "j"]):
            node, counts, u, v = group(f)
            yield pd.DataFrame({"edge": False, "u": node, "v": counts})
            yield pd.DataFrame({"edge": True, "u": u, "v": v})

    return run


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in rows sorted by them."""
    held: list[pd.DataFrame] = []
    key = None
    for f in frames:
        if not len(f):
            continue
        k = f[keys].to_numpy(np.int64)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(f)]
        for b, e in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(k[b])
            if held and now != key:
                yield pd.concat(held, ignore_index=True)
                held = []
            key = now
            held.append(f.iloc[b:e])
    if held:
        yield pd.concat(held, ignore_index=True)


def embedding_components(vectors: DataFrame, scratch: Scratch | None = None, least: float = COSINE, split: int = SPLIT, cell: int = CELL, fanout: int = FANOUT) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: a row per row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, and only vectors of one
    length link. n_links counts the other rows that a row's own vector links with. Rows with one vec_id but different
    vectors are one in components: their groups are pooled. A row whose vec_id is null links with nothing, has a null
    component and is kept. Other columns, labels included, are ignored; an empty table gives no rows.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "embedding")
    rows = usable(vectors)
    named = rows.where("v is not null and vec_id is not null")
    distinct = named.groupBy("v").agg(F.min("vec_id").alias("least"), F.max("vec_id").alias("greatest"), F.count("*").alias("n"))
    distinct = scratch.keep(distinct.withColumn("node", F.monotonically_increasing_id()))
    placed = scratch.keep(in_cells(distinct, scratch, least, split, cell, fanout))
    size = placed.groupBy("d", "cell").agg(F.ceil(F.count("*") * F.col("d") / BLOCK_NUMBERS).alias("g"))
    dealt = placed.join(size, ["d", "cell"]).withColumn("b", F.pmod(F.xxhash64("node"), F.col("g"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    dealt = dealt.select("d", "cell", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), "v", "node", "n", "cells")
    found = scratch.keep(dealt.repartition("d", "cell", "i", "j").sortWithinPartitions("d", "cell", "i", "j").mapInPandas(_multiply(least), "edge boolean, u long, v long"))
    # vectors of one vec_id are pooled: each is tied to the first of them
    own = named.join(distinct.select("v", "node"), "v").select("vec_id", "node").distinct()
    pooled = own.groupBy("vec_id").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    ties = own.join(pooled, "vec_id").select(F.col("node").alias("u"), F.col("first").alias("v"))
    groups = components(found.where("edge").select("u", "v").unionByName(ties), scratch).withColumnRenamed("node", "of")
    counts = found.where("not edge").groupBy(F.col("u").alias("counted")).agg(F.sum("v").alias("links"))
    known = distinct.join(counts, F.col("node") == F.col("counted"), "left").join(groups, F.col("node") == F.col("of"), "left")
    known = scratch.keep(known.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("c")))
    names = known.groupBy("c").agg(F.min("least").alias("component_id"))
    known = known.join(names, "c").select("v", "n_links", "component_id")
    alone = rows.where("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = named.join(known, "v").select("vec_id", "n_links", "component_id")
    out = joined.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_spherical_kmeans_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_components(load(spark, sf_dir, "embeddings"))
