"""Toxicity scores from a counterfactually regularised linear classifier.

Labelled texts that name a group are paired with counterfactuals: the same text with each identity term swapped for
another one. Training adds to the log loss the mean squared change of the logit between the two (counterfactual logit
pairing: Garg et al., 2019), so that neutral mentions of a group don't move the score.

Features are the words of a text and their first 4, 5 and 6 letters, each present or absent. Their counts by class are
aggregated over all labelled rows that are not held out; the fit itself takes a sample of at most FIT_ROWS rows of each class, weighted back
to the class's true size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import load

#: Most labelled rows of a class that are fitted, features, rows that a feature must be in, and its least log odds
#: ratio in standard errors.
FIT_ROWS, FEATURES, LEAST, SURE = 3000, 6000, 2, 2.4
PAIR_WEIGHT, RIDGE, STEPS, RATE, THRESHOLD = 5.0, 1e-4, 400, 0.05, 0.3
LETTERS = re.compile(r"[^\W\d_]+")

#: Identity terms; each swaps with the others of its line.
IDENTITY = [
    "women men woman man girls boys".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "black white asian latino african arab".split(),
    "gay lesbian straight transgender queer bisexual".split(),
    "immigrants refugees foreigners migrants natives citizens".split(),
    "frauen männer juden muslime christen ausländer".split(),
    "femmes hommes juifs musulmans chrétiens immigrés".split(),
    "mujeres hombres judíos musulmanes cristianos inmigrantes".split(),
]


def held_out(doc_id: Column) -> Column:
    """Rows kept from all learning: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: str | None) -> set[str]:
    """Words of a text, and their first letters marked by length."""
    words = set(LETTERS.findall(" ".join(set((text or "").lower().split()))))
    return words | {w[:n] + "*" for n in (4, 5, 6) for w in words if len(w) >= n}


def swapped(text: str | None) -> str | None:
    """The text with each identity term swapped for the next of its line; none if it names no group."""
    if not text:
        return None
    found = False

    def other(m: re.Match) -> str:
        nonlocal found
        if (to := _NEXT.get(m[0].lower())) is None:
            return m[0]
        found = True
        return to

    out = LETTERS.sub(other, text)
    return out if found else None


_NEXT = {w: line[(i + 1) % len(line)] for line in IDENTITY for i, w in enumerate(line)}


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with each feature by class, summed over each batch."""
    for f in frames:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(f["text"], f["toxic"], strict=True):
            for x in features(text):
                counts.setdefault(x, [0, 0])[toxic] += 1
        yield pd.DataFrame([(x, n, p) for x, (n, p) in counts.items()], columns=["feature", "n", "p"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, most_features: int = FEATURES, pair_weight: float = PAIR_WEIGHT) -> dict:
    """The model: weights by feature, and a bias. Only labelled rows that are not held out are looked at.

    Null labels and ids, and labels without a document, are ignored; an id with both labels is toxic, and of rows with
    one id the fit's sample takes the least text. Without both classes the model is the class share.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        p = 0.999 if 1 in sizes else 0.001
        return {"bias": float(np.log(p / (1 - p))), "weights": {}}
    sampled = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect() for y in (0, 1)]
    spark = docs.sparkSession
    ids = spark.createDataFrame(pd.DataFrame([(r["doc_id"], r["toxic"]) for s in sampled for r in s], columns=["_id", "toxic"]), "_id long, toxic int")
    # at most 2 * fit_rows ids: small enough to broadcast whatever the input
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = own.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    labelled = own.join(known.withColumnRenamed("doc_id", "_id").hint("merge"), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    counted = labelled.mapInPandas(_count, "feature string, n long, p long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    odds = F.log((F.col("p") + 0.5) / (sizes[1] + 1)) - F.log((F.col("n") + 0.5) / (sizes[0] + 1))
    weight = F.abs(odds) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    named = F.col("feature").isin(list(_NEXT))
    best = counted.where((F.col("n") + F.col("p") >= LEAST) & (named | (weight >= SURE))).orderBy(named.desc(), weight.desc(), "feature").limit(most_features).select("feature").collect()
    index = {r[0]: i for i, r in enumerate(best)}

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = lambda t: sorted(index[x] for x in features(t) if x in index)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "toxic": f["toxic"], "own": [at(t) for t in f["text"]], "pair": [None if (s := swapped(t)) is None else at(s) for t in f["text"]]})

    rows = texts.mapInPandas(encoded, "doc_id long, toxic int, own array<int>, pair array<int>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["own"]))
    return {"bias": 0.0, "weights": {}} if not rows else _descend(rows, index, sizes, pair_weight)


def _descend(rows: list, index: dict[str, int], sizes: dict[int, int], pair_weight: float) -> dict:
    """Adam over the whole sample at once."""
    y = np.array([r["toxic"] for r in rows], float)
    seen = {k: max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.where(y == 1, sizes[1] / seen[1], sizes[0] / seen[0])
    weight /= weight.sum()
    csr = lambda sets: (np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([i for s in sets for i in s], np.int64))
    row, col = csr([r["own"] for r in rows])
    paired = [r for r in rows if r["pair"] is not None]
    (ra, ca), (rb, cb) = csr([r["own"] for r in paired]), csr([r["pair"] for r in paired])
    d, n, m = len(index), len(rows), len(paired)
    w, b = np.zeros(d), float(np.log(sizes[1] / sizes[0]))
    m1, m2 = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(row, w[col], n) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.bincount(col, g[row], d) + RIDGE * w
        if m:
            apart = np.bincount(ra, w[ca], m) - np.bincount(rb, w[cb], m)
            grad += 2 * pair_weight / m * (np.bincount(ca, apart[ra], d) - np.bincount(cb, apart[rb], d))
        grad = np.append(grad, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return {"bias": float(b), "weights": {x: float(w[i]) for x, i in index.items() if w[i]}}


def scorer(model: dict):
    """The score as a function of a text column, from the whole text alone; null and empty texts score the bias."""
    bias = model["bias"]
    words = {x: v for x, v in model["weights"].items() if not x.endswith("*")}
    starts = {n: {x[:-1]: v for x, v in model["weights"].items() if len(x) == n + 1 and x.endswith("*")} for n in (4, 5, 6)}

    def logit(text: str | None) -> float:
        own = set(LETTERS.findall(" ".join(set((text or "").lower().split()))))
        z = bias + sum(words[x] for x in sorted(own & words.keys()))
        for n, known in starts.items():  # a shorter word has no start of n letters and equals none of known
            z += sum(known[x] for x in sorted({w[:n] for w in own} & known.keys()))
        return z

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array([logit(t) for t in texts], float), -40, 40))))

    return lambda text: run(text.cast("string"))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score double, predicted int`` of every row. Repeated rows score alike; other columns are ignored."""
    out = docs.select(F.col("doc_id").cast("long"), scorer(model)(F.col("text")).alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    return docs.where(scorer(model)(F.col("text")) < threshold)


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = load(spark, sf_dir, "documents")
    out = score(docs, fit(docs, load(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
