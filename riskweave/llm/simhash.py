"""SimHash near-duplicate detection with pigeonring candidate filtering.

A fingerprint of 64 bits is read as a ring of M = 7 segments. If two fingerprints differ in at most T = 4 bits,
some start i exists from which every chain of l consecutive segments differs in at most floor(l * T / M) bits
(Qin and Xiao, "Pigeonring", 2018): 0, 1, 1, 2, 2, 3 and 4 bits for l = 1..7. So segment i agrees, one of the next
two agrees, and two of the next four do. Each such choice of three agreeing segments is a join key of 27 or 28
bits; inside a bucket the chain budgets prune pairs step by step, and only then whole fingerprints are compared.

Buckets emit star forests, never all pairs. A bucket with more rows than BUCKET is dealt out again as pairs of
chunks, so no task holds it whole and no pair is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from riskweave.llm.common import Scratch, load, local_roots, quoted
from riskweave.llm.components import components
from riskweave.llm.lines import _dealt, _new, _whole, pairs_of_runs, shared_keys

#: Differing bits that still link, and segments of the ring.
T, M = 4, 7
CUTS = [round(64 * i / M) for i in range(M + 1)]
MASKS = [((1 << CUTS[i + 1]) - 1) ^ ((1 << CUTS[i]) - 1) for i in range(M)]
BUDGETS = [length * T // M for length in range(1, M + 1)]
#: (start, mask) of each join key: the start, and two of the next four segments with one of the next two.
KEYS = [(i, MASKS[i] | MASKS[(i + a) % M] | MASKS[(i + b) % M]) for i in range(M) for a, b in combinations(range(1, 5), 2) if a <= 2]
STARTS = np.array([i for i, _ in KEYS])
FOUND = "hot boolean, u long, v long"
#: Of near-duplicate texts: words of a shingle, least Jaccard similarity, keys, least hashes of each, texts compared by a task.
WIDTH, JACCARD, BANDS, ROWS, GROUP = 5, 0.8, 14, 4, 1024
ODDS = np.random.default_rng(64).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Rows of a bucket that one task compares; larger buckets are split into chunks of half as many.
BUCKET = 8192


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the word shingles of a text, as an unsigned integer; 0 for no words."""
    return of_hashes(shingle_hashes(text, width))


def shingle_hashes(text: str | None, width: int) -> bytes:
    """The hashes of the word shingles of a text, repeats included, one after the other; of fewer words the whole sequence is one."""
    words = (text or "").encode().lower().split()
    if not words:
        return b""
    found = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return b"".join([xxh64_digest(s, 42) for s in found])


def of_hashes(hashes: bytes) -> int:
    """The SimHash of shingle_hashes."""
    n = len(hashes) // 8
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        block = np.frombuffer(hashes, np.uint8, min(4096, n - at) * 8, at * 8)
        ones += np.unpackbits(block).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def shingles(text: str | None, width: int) -> np.ndarray:
    """The hashes of the different word shingles of a text, sorted; none of a text without words."""
    return np.unique(np.frombuffer(shingle_hashes(text, width), np.uint64))


def _fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        fp = np.fromiter(map(fingerprint, f["text"]), np.uint64, len(f)).view(np.int64)
        yield pd.DataFrame({"doc_id": f["doc_id"], "fp": fp})


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id long, fp long`` (the 64 bits, read as signed) of every row of docs."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(_fingerprints, "doc_id long, fp long")


def near(a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Positions of the pairs a-b (unsigned) within T bits, pruned by the chains from start first."""
    x = a ^ b
    at = np.arange(len(x))
    for s in np.unique(start):
        own = at[start == s] if isinstance(start, np.ndarray) else at
        sums = np.zeros(len(own), np.uint8)
        for length in range(M - 1):
            sums = sums + np.bitwise_count(x[own] & np.uint64(MASKS[(s + length) % M]))
            if length:
                ok = sums <= BUDGETS[length]
                own, sums = own[ok], sums[ok]
        yield own[np.bitwise_count(x[own]) <= T]


def _pairs(run: np.ndarray, fp: np.ndarray, start: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions among rows sorted by run; side: only rows of different sides are compared, if it isn't -1."""
    ends = np.flatnonzero(np.r_[run[1:] != run[:-1], True]) + 1
    begins = np.r_[0, ends[:-1]]
    small = ends - begins <= 24
    in_small = np.repeat(small, ends - begins)
    for gap in range(1, 24):
        left = np.flatnonzero((run[:-gap] == run[gap:]) & in_small[:-gap]) if gap < len(run) else ends[:0]
        if not len(left):
            break
        if side is not None:
            left = left[(side[left] < 0) | (side[left] != side[left + gap])]
        for own in near(fp[left], fp[left + gap], start[left]):
            yield left[own], left[own] + gap
    for b, e in zip(begins[~small], ends[~small], strict=True):
        for i in range(b, e, 256):
            rows = np.arange(i, min(i + 256, e))
            left, right = np.repeat(rows, e - b), np.tile(np.arange(b, e), len(rows))
            ok = left < right
            if side is not None:
                ok &= (side[left] < 0) | (side[left] != side[right])
            left, right = left[ok], right[ok]
            for own in near(fp[left], fp[right], int(start[b])):
                yield left[own], right[own]


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by (k, key, part); of buckets that are too large only (k, key) comes out, as hot."""
    rest = None
    for last, f in _with_end(frames):
        f = pd.concat([rest, f], ignore_index=True) if rest is not None else f
        if not len(f):
            continue
        k, key, part = (f[c].to_numpy(np.int64) for c in ("k", "key", "part"))
        new = np.r_[True, (k[1:] != k[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        cut = len(f) if last else int(np.flatnonzero(new)[-1])
        if cut == 0:  # one bucket fills all that is held; of a large one no more than its size matters
            rest = f.iloc[: BUCKET + 1] if part[0] < 0 else f
            continue
        rest = None if last else f.iloc[cut:]
        k, key, part, run = k[:cut], key[:cut], part[:cut], np.cumsum(new)[:cut]
        fp, rep, side = f["fp"].to_numpy(np.int64)[:cut].view(np.uint64), f["rep"].to_numpy(np.int64)[:cut], f["side"].to_numpy(np.int64)[:cut]
        hot = (np.bincount(run)[run] > BUCKET) & (part < 0)
        if hot.any():
            yield pd.DataFrame({"hot": True, "u": k[hot], "v": key[hot]}).drop_duplicates()
            k, run, fp, rep, side = (x[~hot] for x in (k, run, fp, rep, side))
        found, n = [], 0
        for left, right in _pairs(run, fp, STARTS[k], side) if len(run) else ():
            found.append((rep[left], rep[right]))
            n += len(left)
            if n > 1 << 20:
                found = [local_roots(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                n = len(found[0][0])
        if found:
            u, v = local_roots(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pd.DataFrame({"hot": False, "u": u, "v": v})


def _with_end(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Each frame, and an empty last one marked as the end."""
    f = None
    for f in frames:
        yield False, f
    if f is not None:
        yield True, f.iloc[:0]


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """``u long, v long``: edges between rep ids of the distinct fingerprints (``fp long, rep long``) within T bits."""
    keys = F.array(*(F.struct(F.lit(n).alias("k"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("key")) for n, (_, m) in enumerate(KEYS)))
    rows = prints.select("fp", "rep", F.explode(keys).alias("x")).select("x.k", "x.key", F.lit(-1).cast("long").alias("part"), F.lit(-1).cast("long").alias("side"), "fp", "rep")
    found = scratch.keep(rows.repartition("k", "key").sortWithinPartitions("k", "key").mapInPandas(_compare, FOUND))
    edges, hot = found.where("not hot").select("u", "v"), found.where("hot").select(F.col("u").cast("int").alias("k"), F.col("v").alias("key")).distinct()
    if hot.isEmpty():
        return edges
    dense = rows.drop("part", "side").join(hot, ["k", "key"])
    size = dense.groupBy("k", "key").agg(F.ceil(F.count("*") / (BUCKET // 2)).alias("g"))
    dealt = dense.join(size, ["k", "key"]).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    part = (F.least("c", "o") * F.col("g") + F.greatest("c", "o")).alias("part")
    dealt = dealt.select("k", "key", part, F.when(F.col("c") == F.col("o"), F.lit(-1).cast("long")).otherwise(F.col("c")).alias("side"), "fp", "rep")
    twice = dealt.repartition("k", "key", "part").sortWithinPartitions("k", "key", "part").mapInPandas(_compare, FOUND)
    return edges.unionByName(scratch.keep(twice.select("u", "v")))


def simhash_components(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id long, fingerprint string, component_id long`` for every row of docs.

    component_id is the smallest doc_id reachable over links of at most T differing bits. A null or wordless text
    has fingerprint 0 and is linked like any other. Rows with one doc_id are one document: their links are pooled.
    A row whose doc_id is null links with nothing and has a null component. Other columns of docs are ignored; an
    empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    out = grouped(scratch.keep(fingerprints(docs)), scratch)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def grouped(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds component_id to ``doc_id long, fp long``: the smallest doc_id reachable over links of at most T bits."""
    reps = scratch.keep(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # rows of one document with different fingerprints join its groups
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    own = prints.join(several, "doc_id").join(reps, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(links(reps, scratch).unionByName(own), scratch)
    named = reps.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left")


def _contents(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """The hash of each text's words, the SimHash of its shingles, and keys that texts with most of them in common are likely to share."""
    for f in frames:
        content, keys, prints = [], [], []
        for text in f["text"]:
            hashes = shingle_hashes(text, width)
            prints.append(of_hashes(hashes))
            found = np.unique(np.frombuffer(hashes, np.uint64))
            least = (found[:, None] * ODDS).min(axis=0) if len(found) else ODDS
            content.append(xxh64_digest(b" ".join((text or "").encode().lower().split())))
            keys.append([xxh64_digest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))])
        signed = lambda x: np.frombuffer(b"".join(x), ">i8").astype(np.int64)
        yield pd.DataFrame({"doc_id": f["doc_id"], "content": signed(content), "fp": np.array(prints, np.uint64).view(np.int64), "keys": [signed(x) for x in keys]})


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of at least least; sets of nothing are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= least * max(len(a), len(b)) - 1e-9 else 0
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _alike(frames: Iterator[pd.DataFrame], width: int, least: float) -> Iterator[pd.DataFrame]:
    """Star forests of the texts that are alike in each part of each bucket."""
    for f in _whole(frames, ["a", "b", "part"]):
        ids, first, at = np.unique(f["id"].to_numpy(np.int64), return_index=True, return_inverse=True)
        side, run = f["side"].to_numpy(np.int64), np.cumsum(_new(*(f[c].to_numpy(np.int64) for c in ("a", "b", "part"))))
        sets = [shingles(t, width) for t in f["text"].iloc[first]]
        root = np.arange(len(ids))
        for left, right in pairs_of_runs(run):
            ok = (side[left] < 0) | (side[left] != side[right])
            for i, j in zip(at[left[ok]].tolist(), at[right[ok]].tolist(), strict=True):
                if root[i] != root[j] and alike(sets[i], sets[j], least):
                    root[root == root[j]] = root[i]
        apart = root != np.arange(len(ids))
        yield pd.DataFrame({"u": ids[apart], "v": ids[root[apart]]})


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = WIDTH, least: float = JACCARD) -> DataFrame:
    """``gone long``: the doc_ids that are not the smallest of their group of near-duplicates.

    Texts link if the sets of their word shingles have a Jaccard similarity of at least least. Pairs are looked for
    in the groups that the ring makes of the SimHashes of these shingles (as simhash_components does), all pairs of a
    group. Two texts at 0.8 differ in some ten bits, which no ring reaches; so further pairs come from BANDS keys of
    ROWS least hashes each: one at 0.8 shares a key 99.9 times in 100. Texts without words are equal. Rows with one
    doc_id are one document; a null doc_id links with nothing.
    """
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    prints = scratch.keep(src.mapInPandas(lambda x: _contents(x, width), "doc_id long, content long, fp long, keys array<long>"))
    reps = prints.groupBy("content").agg(F.min(F.struct("doc_id", "fp", "keys")).alias("x")).select("content", "x.doc_id", "x.fp", "x.keys")
    ring = grouped(scratch.keep(reps.select(F.col("content").alias("doc_id"), "fp")), scratch).select(F.col("component_id").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("doc_id").alias("id"))
    several = ring.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    shared = shared_keys(reps.select(F.explode("keys").alias("key"), F.col("content").alias("id"), F.lit(0).cast("long").alias("tell")), scratch).drop("tell")
    # a ring's group has no key's number
    shared = scratch.keep(shared.unionByName(ring.join(several, "a")))
    wanted = reps.join(shared.select(F.col("id").alias("content")).distinct(), "content").select(F.col("doc_id").alias("_doc")).distinct()
    # rows that share a doc_id have texts of their own
    texts = src.join(wanted.hint("merge"), F.col("doc_id") == F.col("_doc")).select("text")
    texts = scratch.keep(texts.mapInPandas(_named, "id long, text string").groupBy("id").agg(F.min("text").alias("text")))
    dealt = _dealt(shared, ["a", "b"], GROUP, "id").join(texts.hint("merge"), "id").select("a", "b", "part", "side", "id", "text")
    edges = scratch.keep(dealt.repartition("a", "b", "part").sortWithinPartitions("a", "b", "part", "id").mapInPandas(lambda x: _alike(x, width, least), "u long, v long"))
    # rows of one document with different texts join its groups
    several = prints.groupBy("doc_id").agg(F.min("content").alias("v"), F.max("content").alias("w")).where("v <> w")
    groups = components(edges.unionByName(several.join(prints, "doc_id").select(F.col("content").alias("u"), "v")), scratch)
    named = prints.select("doc_id", "content").join(groups, F.col("content") == F.col("node"), "left").select("doc_id", F.coalesce("component", "content").alias("component"))
    stays = named.groupBy("component").agg(F.min("doc_id").alias("stays"))
    return named.join(stays, "component").where("doc_id <> stays").select(F.col("doc_id").alias("gone")).distinct()


def _named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        content = b"".join([xxh64_digest(b" ".join((t or "").encode().lower().split())) for t in f["text"]])
        yield pd.DataFrame({"id": np.frombuffer(content, ">i8").astype(np.int64), "text": [t or "" for t in f["text"]]})


def keep_one(docs: DataFrame, scratch: Scratch | None = None, gone: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns, that are the first of their group: of gone, or else of simhash_components.

    Rows with a null doc_id stay; rows that share a doc_id stay or go together.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    if gone is None:
        gone = simhash_components(docs, scratch).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(scratch.keep(gone), F.col("id") == F.col("gone"), "left_anti").select("row.*")


def op8_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(load(spark, sf_dir, "documents"))
