"""Bottom-k sketches of word-shingle hashes: resemblance, containment and distinct counts, mergeable across parts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from riskweave.llm.common import load

#: Hashes that a sketch keeps, and words of a shingle.
K, WIDTH = 256, 5
#: Rows of a range of doc_ids, and most ranges (their bounds are one literal of the plan).
RANGE_ROWS, MOST_RANGES = 2_000, 100_000
LOWEST = -(1 << 63)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def hashes(w: list[bytes]) -> np.ndarray:
    """Hash of each shingle in turn, as 32 bits; fewer words than a shingle has are one shingle, no words none."""
    if len(w) < WIDTH:
        w = [b" ".join(w)] if w else []
    else:
        w = map(b" ".join, zip(*(w[i:] for i in range(WIDTH)), strict=False))
    return np.frombuffer(b"".join([xxh64_digest(s) for s in w]), ">u4")[::2].astype(np.uint32)


def sketch(h: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct hashes, ascending."""
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((int(a[k - 1]) + 1) / 2**32)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True).astype(int) @ np.isin(both, b, assume_unique=True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    j = resemblance(a, b, k)
    return min(1.0, j / (1 + j) * (distinct(a, k) + distinct(b, k)) / distinct(a, k)) if len(a) else 1.0


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u4").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``<key>, fingerprint string, shingles double`` of every row: the sketch and the distinct shingles it estimates.

    A null or empty text has the empty sketch; equal texts have equal sketches; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = [sketch(hashes(words(t))) for t in f["text"]]
            yield pd.DataFrame({key: f[key], "fingerprint": [encode(x) for x in own], "shingles": [distinct(x) for x in own]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col("text").cast("string")).mapInPandas(run, f"{key} {kind}, fingerprint string, shingles double")


def _longs(values: list[int]) -> Column:
    """An array as one literal."""
    return F.lit(np.array(values, np.int64)) if values else F.array().cast("array<long>")


def _below(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are below value, by binary search."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    held, steps = _longs(bounds), [1 << i for i in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(at + step > n, at).when(F.get(held, at + step - 1) < value, at + step).otherwise(at))


def _span(bounds: list[int], place: Column, share: Column) -> Column:
    """The range of a row: a place that is several bounds is cut into as many ranges, by its rows' share (from 0, below 1)."""
    below = _below(bounds, place)
    same = _below(bounds, place + 1) - below  # no place is the highest long
    return below + F.floor(share * F.greatest(same, F.lit(1))).cast("int")


def _edits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive by range, within it by descending doc_id, after them the first row of what follows the range."""
    before = None
    for f in frames:
        rows = []
        for span, ahead, doc, text in zip(f["span"], f["ahead"], f["id"], f["text"], strict=True):
            text = text or ""
            w = words(text)
            h = hashes(w)
            now = (span, doc, text, w, h, sketch(h), ahead)
            if before is not None and before[0] == span and not before[-1]:
                rows.append(_edited(before, now))
            before = now
        out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        yield out.astype({"doc_id": "Int64"})


def _edited(own: tuple, following: tuple) -> tuple:
    _, doc, text, w, h, mine, _ = own
    n = len(text)
    k = n // 3
    kept = text[: n - k]
    edited = kept + following[2][:k]
    same = max(0, min(len(words(kept)) - WIDTH, len(h))) if len(w) >= WIDTH else 0  # shingles wholly before the cut
    e = words(edited)
    other = sketch(np.concatenate([h[:same], hashes(e[same:])]) if len(e) >= WIDTH and len(e) - same >= WIDTH else hashes(e))
    return (None if pd.isna(doc) else int(doc), n, hashlib.sha256(edited.encode()).hexdigest(), encode(mine), encode(other), resemblance(mine, other), resemblance(mine, following[5]))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint beside that of its edited text, whose last third is the start of the next document's.

    Next is the next lower doc_id, after the lowest (nulls are lowest) the highest; a lone row follows itself.
    Rows with one doc_id follow each other by a hash of their texts. Only doc_ids and hashes are ranked over all rows:
    texts are dealt to ranges of doc_ids (an id of many rows to several), and each range also gets the one row that
    follows it. An empty table gives an empty result.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place, share = F.coalesce("id", F.lit(LOWEST)), F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)
    ids = src.select(place.alias("p"), share.alias("u"))
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    bounds = sorted(ids.agg(F.percentile_approx("p", F.lit(np.arange(1, ranges) / ranges), F.lit(10 * ranges))).first()[0]) if ranges > 1 else []
    tops = {r["span"]: r["top"] for r in ids.groupBy(_span(bounds, F.col("p"), F.col("u")).alias("span")).agg(F.max(F.struct("p", "u")).alias("top")).collect()} if n else {}
    spans = sorted(tops)
    count = len(bounds) + 1
    ahead_of = {s: spans[(i + 1) % len(spans)] for i, s in enumerate(spans)}
    first = [tops[s]["p"] if s in tops else LOWEST for s in range(count)]
    first_share = [tops[s]["u"] if s in tops else -1.0 for s in range(count)]
    target = [ahead_of.get(s, -1) for s in range(count)]
    dealt = src.withColumn("p", place).withColumn("u", share).withColumn("s", _span(bounds, F.col("p"), F.col("u")))
    own = F.struct(F.col("s").alias("span"), F.lit(0).alias("ahead"))
    more = F.struct(F.get(_longs(target), F.col("s")).cast("int").alias("span"), F.lit(1).alias("ahead"))
    is_top = (F.get(_longs(first), F.col("s")) == F.col("p")) & (F.get(F.lit(np.array(first_share)), F.col("s")) == F.col("u"))
    dealt = dealt.withColumn("x", F.explode(F.when(is_top, F.array(own, more)).otherwise(F.array(own)))).select("x.span", "x.ahead", "id", "u", "text")
    # one range at a time in a task, rows in order; of several rows ahead only the first is looked at
    ordered = dealt.repartition("span").sortWithinPartitions("span", "ahead", F.col("id").desc_nulls_last(), F.col("u").desc(), F.col("text").desc()).drop("u")
    return ordered.mapInPandas(_edits, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(load(spark, sf_dir, "documents"))
