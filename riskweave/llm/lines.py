"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, one occurrence per connected group.

Lines are compared in a normal form: lower case, white space runs as one blank. Empty lines are left alone. Equal
normal forms of any other length are one line whose occurrences are counted. Different ones of FUZZY_LETTERS letters or
FUZZY_WORDS words or more link if they share a key and their edit similarity (1 - Levenshtein distance over the longer
length) is at least SIMILARITY, however far apart their SimHashes are. Of each connected group the first occurrence
stays, by (doc_id, hash of the document's text, line number).

Keys come from pigeonhole blocks: SimHashes within T = 2 bits agree on two of four blocks, so each pair of blocks is a
key of 32 bits; many pairs further apart share one too. A few edits leave some part of a line untouched, so the two first and the
two last quarters of its words (of short lines the halves) are keys as well. And lines that share most of their letters
in whole words share the least of them by some hashes, a word weighing as much as it has letters: BANDS keys of ROWS
such words find them when an edit is in every part.

Two lines of a key are told apart without their texts if their lengths forbid the similarity, or if more than DIFFER of
SLOTS least words differ (of lines whose keys are made of letters, by length alone). Lines that share SIMILARITY of
their letters in whole words have two thirds of their weight in common; then one pair in 10,000 has more than DIFFER.

Words are hashed where they lie, by differences of a running polynomial over a batch's bytes: nothing is looked up a
word at a time, and nothing is remembered from one batch to the next but the digests of some lines. Only lines
that are left with another one are fetched. Of a key's lines all pairs are looked at, in pairs of chunks where there are
many; aligning words proves most similar pairs, and counts of letter pairs, of which an edit changes two at most,
disprove most others. What is left takes an edit distance. An accepted pair joins two parts, so a group costs about as
many distances as it has lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from riskweave.llm.common import Scratch, load, local_roots, quoted
from riskweave.llm.components import components

#: Edit similarity that links.
SIMILARITY = 0.8
#: Letters, or words, from which lines that differ are compared; the letters a word from which its letters stand for words.
FUZZY_LETTERS, FUZZY_WORDS, LONG_WORD = 10, 5, 20
#: Differing bits that surely give a common key, and blocks.
T, BLOCKS = 2, 4
#: Keys from least words, and words of each.
BANDS, ROWS = 8, 4
CUTS = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
KEYS = [sum(((1 << CUTS[i + 1]) - 1) ^ ((1 << CUTS[i]) - 1) for i in pair) for pair in combinations(range(BLOCKS), BLOCKS - T)]
#: Least words of which two bits tell lines apart, and how many may differ; a step between lengths, and steps to 1 / SIMILARITY.
SLOTS, DIFFER, STEP = 24, 14, 0.005
STEPS = int(np.log(1 / SIMILARITY) / STEP) + 2
#: The other keys.
PARTS = [f"p{i}" for i in range(4 + BANDS)]
#: Rows of a bucket that one task holds, and lines that it compares; larger ones are dealt as pairs of chunks half as large.
BUCKET, GROUP = 8192, 1024
#: Letters of a batch that is hashed at once, letters from which a word counts as its hash, digests that a task remembers.
BATCH, HUGE_WORD, REMEMBERED = 1 << 20, 1 << 16, 200_000
#: Keys that a task packs at once; a part has half as many about.
PACKED = 1 << 20
#: Pairs that wait for their distances, and at first in one large bucket; pairs that are measured side by side, and fewer that are not.
WAITING, SOON, ABREAST, FEW = 8192, 512, 1024, 6
#: Words are aligned if no larger share of the letter pairs that most edits may change differs, or if a line is longer than that.
LIKELY, LONG = 0.4, 3000
#: What is over any distance there: most if a byte holds a number, and else; rows and letters that a task compares at once.
NEAR, FAR, ROWS_AT_ONCE, LETTERS = 190, 15_000, 40_000, 24 << 20
#: Counts of letter pairs that each line is told by, and words that may be skipped when two lines are aligned.
COUNTS, SKIP = 256, 4

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Base of the running polynomial (odd, so that it has an inverse).
BASE = 0x2545F4914F6CDD1D


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values with their bits stirred (the splitmix finish)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: The bits of a byte as the bytes of a word, highest first.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def tokens(line: str) -> str:
    """What the keys of a normal form are made of, between blanks: its words; of few words or of text without blanks, its runs of three letters.

    Words of HUGE_WORD letters or more count as their hashes.
    """
    n = line.count(" ") + 1
    if n < FUZZY_WORDS or len(line) - n + 1 >= LONG_WORD * n:
        line = line.replace(" ", "_")
        return " ".join([line[i : i + 3] for i in range(max(1, len(line) - 2))])
    if len(line) >= HUGE_WORD:
        return " ".join([w if len(w) < HUGE_WORD else f"{xxh64_intdigest(w.encode()):016x}" for w in line.split(" ")])
    return line


_powers: list[np.ndarray] = []


def words(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines of tokens: a hash and the length in bytes of each token, and how many tokens each line has."""
    if not _powers:
        size, inverse = BATCH + 4 * HUGE_WORD, pow(BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (BASE, inverse)]
    up, down = _powers
    raw = np.frombuffer("\n".join([*lines, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    begins = np.r_[0, ends[:-1] + 1]
    h = np.empty(len(ends), np.uint64)
    at = 0
    while at < len(ends):  # whole words, some BATCH bytes at a time
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + BATCH)))
        own = raw[begins[at] : ends[to - 1]]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * up[: len(own)], out=sums[1:])
        b, e = begins[at:to] - begins[at], ends[at:to] - begins[at]
        h[at:to] = (sums[e] - sums[b]) * down[b]
        at = to
    return mixed(h), ends - begins, np.diff(np.r_[-1, np.flatnonzero(raw[ends] == 10)])


def simhashes(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit SimHash over the neighbouring words of each line, as unsigned integers; ties of a bit give 0.

    Single words would not do: long lines of one language share most of their common words.
    """
    lanes = LANES[mixed(h * np.uint64(3) + np.roll(h, -1)).view(np.uint8)].reshape(-1, 8)
    stops = np.cumsum(sizes)
    lanes[stops - 1] = 0  # the pair across lines
    # bytes hold counts of up to 255: sums over parts of lines first, then over the parts
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    begins = np.repeat(stops - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    counts = np.add.reduceat(lanes, begins, axis=0).view(np.uint8).astype(np.int64)
    if len(counts) > len(sizes):
        counts = np.add.reduceat(counts, first, axis=0)
    return np.packbits(2 * counts > sizes[:, None] - 1, axis=1).view(np.uint64)[:, 0]


def part_keys(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys of four parts of each line: the first, last, second and last but one quarter of its words, in steps of four words.

    Lines of less than 32 words have the first and the last half, twice.
    """
    stops = np.cumsum(sizes)
    begins = stops - sizes
    short = sizes < 32
    q = np.where(short, np.where(sizes < 8, sizes // 2, sizes // 8 * 4), sizes // 16 * 4)
    place = np.arange(len(h)) - np.repeat(begins, sizes)
    from_start = np.r_[np.uint64(0), np.cumsum(mixed(h + place.astype(np.uint64) * ODD))]
    from_end = np.r_[np.uint64(0), np.cumsum(mixed(h - (place - np.repeat(sizes, sizes)).astype(np.uint64) * ODD))]
    head, tail = from_start[begins + q] - from_start[begins], from_end[stops] - from_end[stops - q]
    twice = np.where(short, 0, q)
    second, fourth = from_start[begins + q + twice] - from_start[begins + twice], from_end[stops - twice] - from_end[stops - q - twice]
    tags = np.arange(1, 5, dtype=np.uint64)
    return mixed(np.c_[head, tail, second, fourth] * np.uint64(5) + np.where(short[:, None], tags[[0, 1, 0, 1]], tags))


def word_keys(h: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys of each line: of its words those that are least by ROWS hashes divided by the word's length, stirred together.

    And two bits of each of the first SLOTS such words.
    """
    begins = np.cumsum(sizes) - sizes
    share = np.uint64(1 << 16) // np.maximum(lengths, 1).astype(np.uint64)
    out, slots = np.zeros((len(sizes), BANDS), np.uint64), np.zeros(len(sizes), np.uint64)
    for band in range(BANDS):
        for row in range(ROWS):
            at = band * ROWS + row
            turn = np.uint64((at + 1) * int(ODD) % (1 << 64) | 1)
            least = np.minimum.reduceat(((h * turn) >> np.uint64(32)) * share, begins)
            out[:, band] = mixed(out[:, band] * np.uint64(3) + least)
            if at < SLOTS:
                slots |= (mixed(least) >> np.uint64(62)) << np.uint64(2 * at)
    return mixed(out + np.arange(11, 11 + BANDS, dtype=np.uint64) * ODD), slots


def all_keys(lines: list[str], letters: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """What tells each line of tokens apart, its SimHash and the keys named PARTS, read as signed.

    letters: lengths of the normal forms; whole: whether the tokens are their words.
    """
    h, lengths, sizes = words(lines)
    keys, slots = word_keys(h, lengths, sizes)
    tell = slots << np.uint64(16) | (np.log(letters) / STEP).astype(np.uint64) | np.where(whole, 0, 1 << 15).astype(np.uint64)
    return np.c_[tell, simhashes(h, sizes), part_keys(h, sizes), keys].view(np.int64)


def perhaps_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs aren't told apart by what tells lines (signed)."""
    far = np.abs((a & 0x7FFF) - (b & 0x7FFF)) > STEPS
    x = (a ^ b).view(np.uint64) >> np.uint64(16)
    differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x555555555555))
    return ~far & ((differ <= DIFFER) | ((a | b) & 0x8000 != 0))


#: What the keys of a line are made of. A batch's are the bytes of one table of these, in its first row; keyed: its lines.
KEYED = ["h1", "tell", "sim", *PARTS]
LINES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("keyed", pa.int32()), ("keys", pa.binary())])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of doc_id, th, text; keys come with the first of equal lines, as far as a task remembers."""
    docs: list[int] = []
    hashes: list[int] = []
    numbers: list[int] = []
    digests: list[bytes] = []
    fuzzy: list[int] = []
    toks: list[str] = []
    letters: list[int] = []
    seen: set[bytes] = set()

    def out() -> pa.RecordBatch:
        n = len(docs)
        h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        keys = None
        if toks:
            sizes = np.array(letters)
            whole = sizes == np.array([len(x) for x in toks])
            keys = np.c_[h[fuzzy, :1], all_keys(toks, sizes, whole)].tobytes()
        columns = [pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])]
        none = [None] * (n - 1)
        batch = pa.RecordBatch.from_arrays([*columns, pa.array([len(toks) or None, *none], pa.int32()), pa.array([keys, *none], pa.binary())], schema=LINES)
        for x in (docs, hashes, numbers, digests, fuzzy, toks, letters):
            x.clear()
        if len(seen) > REMEMBERED:
            seen.clear()
        return batch

    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for doc, th, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                for n, line in enumerate(text.split("\n")):
                    if not (line := normal(line)):
                        continue
                    docs.append(doc)
                    hashes.append(th)
                    numbers.append(n)
                    digests.append(own := xxh3_128_digest(line.encode("utf-8", "surrogatepass")))
                    held += len(line)
                    if own not in seen and (line.count(" ") >= FUZZY_WORDS - 1 or sum(map(str.isalpha, line)) >= FUZZY_LETTERS):
                        seen.add(own)
                        fuzzy.append(len(docs) - 1)
                        toks.append(tokens(line))
                        letters.append(len(line))
                    if held > BATCH or len(docs) > 20_000:
                        yield out()
                        held = 0
    if docs:
        yield out()


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    return np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a key that aren't told apart from some other one of it, by what connects them: a bucket (a, b); of a key with too many only the key, as hot.

    Rows key, id, tell arrive sorted by key; repeated ones count once.
    """
    for key, node, tell in _whole_keys(batches):
        run = np.cumsum(_new(key)) - 1
        size = np.bincount(run)[run]
        hot, several = size > BUCKET, (size > 1) & (size <= BUCKET)
        if hot.any():
            keys = np.unique(key[hot])
            yield _buckets(True, keys, keys * 0, keys * 0, keys * 0)
        run, node, tell = run[several], node[several], tell[several]
        if not len(run):
            continue
        parent = np.arange(len(run))
        linked: list[np.ndarray] = []
        for left, right in pairs_of_runs(run):
            ok = perhaps_alike(tell[left], tell[right])
            linked.append(np.stack([left[ok], right[ok]]))
            if sum(x.shape[1] for x in linked) > 1 << 20:
                linked = [np.stack(local_roots(*np.concatenate(linked, axis=1)))]
        child, root = local_roots(*np.concatenate(linked, axis=1))
        parent[child] = root
        many = np.bincount(parent, minlength=len(run))
        total = np.zeros(len(run), np.uint64)
        np.add.at(total, parent, mixed(node.view(np.uint64) + ODD))
        kept = many[parent] > 1
        yield _buckets(False, total[parent][kept].view(np.int64), many[parent][kept], node[kept], tell[kept])


BUCKETS = "hot boolean, a long, b long, id long, tell long"


def _buckets(hot: bool, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), hot)), *map(pa.array, columns)], names=["hot", "a", "b", "id", "tell"])


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """key, id, tell of whole keys that have several rows, a batch at a time, without repeats; of one that fills a batch no more than BUCKET + 1 rows."""
    rest = [np.zeros(0, np.int64)] * 3

    def several(own: list[np.ndarray]) -> list[np.ndarray]:
        """By key and id, without repeats, and without keys of one row."""
        new = _new(own[0])
        single = new & np.r_[new[1:], True]
        own = [x[~single] for x in own]
        if len(own[0]):
            order = np.lexsort((own[1], own[0]))
            own = [x[order] for x in own]
            new = _new(own[0], own[1])
            own = [x[new] for x in own]
        return own

    for batch in batches:
        own = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)]
        if not len(own[0]):
            continue
        cut = int(np.flatnonzero(_new(own[0]))[-1])
        rest = [x[cut:] for x in own]
        if len(rest[0]) > BUCKET + 1:
            rest = several(rest) if len(rest[0]) > 1 else rest
            rest = [x[: BUCKET + 1] for x in rest]
        out = several([x[:cut] for x in own]) if cut else own[:0]
        if out and len(out[0]):
            yield tuple(out)
    if len(rest[0]):
        out = several(rest)
        if len(out[0]):
            yield tuple(out)


def pairs_of_runs(run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions inside each run, in bounded batches."""
    if not len(run):
        return
    ends = np.flatnonzero(np.r_[run[1:] != run[:-1], True]) + 1
    begins = np.r_[0, ends[:-1]]
    small = ends - begins <= 24
    in_small = np.repeat(small, ends - begins)
    for gap in range(1, min(24, len(run))):
        left = np.flatnonzero((run[:-gap] == run[gap:]) & in_small[:-gap])
        if not len(left):
            break
        yield left, left + gap
    for b, e in zip(begins[~small], ends[~small], strict=True):
        for i in range(b, e, 256):
            rows = np.arange(i, min(i + 256, e))
            left, right = np.repeat(rows, e - b), np.tile(np.arange(b, e), len(rows))
            yield left[left < right], right[left < right]


def _whole(frames: Iterator[pd.DataFrame], by: list[str], most: int | None = None) -> Iterator[pd.DataFrame]:
    """Rows sorted by some columns in batches of whole runs; one that fills a batch is cut to most rows, if given."""
    rest = None
    for f in frames:
        f = pd.concat([rest, f], ignore_index=True) if rest is not None else f
        if not len(f):
            continue
        cut = int(np.flatnonzero(_new(*(f[c].to_numpy(np.int64) for c in by)))[-1])
        if cut:
            yield f.iloc[:cut]
        rest = f.iloc[cut:]
        if most is not None:
            rest = rest.iloc[:most]
    if rest is not None and len(rest):
        yield rest


def _dealt(rows: DataFrame, by: list[str], most: int, node: str) -> DataFrame:
    """Rows of each group once for every pair of its chunks: adds part, and side (-1: a chunk with itself)."""
    return _dealt_counted(rows.join(rows.groupBy(*by).agg(F.count("*").alias("n")), by), rows.columns, most, node)


def _dealt_counted(rows: DataFrame, columns: list[str], most: int, node: str) -> DataFrame:
    """``_dealt`` of columns, where each row has its group's number of rows as n."""
    g = F.ceil(F.col("n") / (most // 2))
    out = rows.withColumn("g", F.when(g <= 2, 1).otherwise(g).cast("long")).withColumn("c", F.pmod(F.xxhash64(node), F.col("g"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    part = (F.least("c", "o") * F.col("g") + F.greatest("c", "o")).alias("part")
    return out.select(*columns, part, F.when(F.col("c") == F.col("o"), F.lit(-1).cast("long")).otherwise(F.col("c")).alias("side"))


def keyed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of KEYED from rows that hold the bytes of many."""
    for batch in batches:
        for raw in batch.column(0):
            own = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, len(KEYED))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in own.T], names=KEYED)


def packed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Keys of h1, tell, sim and PARTS as rows of many: part, and the bytes of its (key, id, tell).

    A key is in one part. The cluster moves some thousand keys at a time instead of one.
    """
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        rows = np.concatenate(held)
        held.clear()
        part = (mixed(rows[:, 0].view(np.uint64)) % np.uint64(parts)).astype(np.uint16)
        rows = rows[np.argsort(part, kind="stable")]
        n = np.bincount(part, minlength=parts)
        found = np.flatnonzero(n)
        offsets = np.r_[0, np.cumsum(n[found])].astype(np.int32) * 24
        blobs = pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), blobs], names=["part", "rows"])

    for batch in batches:
        own, tell, sim, *keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + len(PARTS)))
        if not len(own):
            continue
        sim = sim.view(np.uint64)
        blocks = [(sim & np.uint64(m) | np.uint64((n + 1) * int(ODD) % (1 << 64) & ~m)).view(np.int64) for n, m in enumerate(KEYS)]
        every = np.stack([*blocks, *keys], axis=1)
        valid = np.ones(every.shape, bool)
        for a, b in ((0, 2), (1, 3)):  # short lines have the same part keys twice
            valid[:, len(KEYS) + b] = keys[a] != keys[b]
        at, _ = np.nonzero(valid)
        held.append(np.stack([every[valid], own[at], tell[at]], axis=1))
        if sum(map(len, held)) >= PACKED:
            yield out()
    if held:
        yield out()


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of part, rows that arrive by part as key, id, tell, equal keys together.

    Of a part that grows large, rows that repeat go, and of a key all but BUCKET + 1.
    """
    held: list[np.ndarray] = []
    now, size, most = None, 0, 4 * PACKED

    def ordered() -> np.ndarray:
        rows = np.concatenate(held)
        return rows[np.argsort(rows[:, 0])]

    def out() -> Iterator[pa.RecordBatch]:
        rows = ordered()
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[i : i + 100_000, j])) for j in range(3)], names=["key", "id", "tell"])

    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != now and held:
                yield from out()
                held, size, most = [], 0, 4 * PACKED
            now = part
            held.append(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, 3))
            size += len(held[-1])
            if size > most:
                rows = np.concatenate(held)
                rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
                rows = rows[_new(rows[:, 0], rows[:, 1])]
                first = np.flatnonzero(_new(rows[:, 0]))
                place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
                held = [rows[place <= BUCKET]]
                size, most = len(held[0]), max(4 * PACKED, 2 * len(held[0]))
    if held:
        yield from out()


def shared_keys(rows: DataFrame, scratch: Scratch, lines: DataFrame | None = None) -> DataFrame:
    """``a long, b long, id long, tell long``: the buckets (a, b) of ``key long, id long, tell long``: ids that share a key and aren't told apart.

    Buckets of the same ids are one. Keys of more than BUCKET ids are found first and then dealt out whole. Where rows
    are the keys of lines (KEYED, or ``keyed int, keys binary`` with the bytes of many), these move packed.
    """
    if lines is None:
        found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, BUCKETS)
    else:
        many = "keys" in lines.columns
        n = (lines.agg(F.sum("keyed")).first()[0] or 0) if many else lines.count()
        parts = min(60_000, max(64, (len(KEYS) + len(PARTS)) * n // (PACKED // 2)))
        pack = lambda batches: packed(keyed_lines(batches) if many else batches, parts)
        packs = lines.select(*(["keys"] if many else KEYED)).mapInArrow(pack, "part int, rows binary")
        found = packs.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: _shared(unpacked(batches)), BUCKETS)
    found = scratch.keep(found)
    out, hot = found.where("not hot").drop("hot").distinct(), found.where("hot").select(F.col("a").alias("key")).distinct()
    if not hot.isEmpty():
        out = out.unionByName(rows.join(hot, "key").select(F.col("key").alias("a"), F.lit(0).cast("long").alias("b"), "id", "tell").distinct())
    out = scratch.keep(out)
    scratch.drop(found)
    return out


def block_keys(sim: Column) -> list[Column]:
    """The blocks of a SimHash two by two; the bits outside are set to the key's number, stirred."""
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x)
    tag = lambda n, m: (n + 1) * int(ODD) % (1 << 64) & ~m
    return [sim.bitwiseAND(signed(m)).bitwiseOR(signed(tag(n, m))) for n, m in enumerate(KEYS)]


def candidate_links(shared: DataFrame, scratch: Scratch, texts: DataFrame | None = None) -> DataFrame:
    """``u, v``: edges that connect the ids of shared (a, b, id, tell) just as all pairs of a bucket that aren't told apart do.

    With ``id, text`` of those ids a pair has to be similar too. Buckets that hang together by their ids, up to BUCKET
    rows, are dealt to one task, so that a pair of several buckets is compared once; larger ones are dealt one by one.
    """
    buckets = shared.groupBy("a", "b").agg(F.min("id").alias("v"), F.count("*").alias("n"))
    counted = scratch.keep(shared.join(buckets, ["a", "b"]))
    together = components(counted.select(F.col("id").alias("u"), "v"), scratch)
    rooted = counted.join(together, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("component", "id"))
    rooted = scratch.keep(_dealt_counted(rooted, [*shared.columns, "root"], GROUP, "id"))
    few = rooted.groupBy("root").agg((F.count("*") <= BUCKET).alias("few"))
    dealt = rooted.join(few, "root").withColumn("deal", F.when(F.col("few"), F.col("root")).otherwise(F.xxhash64("a", "b", "part")))
    dealt = dealt.withColumn("text", F.lit("")) if texts is None else dealt.join(texts.hint("merge"), "id")
    rows = dealt.select("deal", "a", "b", "part", "side", "id", "tell", "text")
    out = scratch.keep(rows.repartition("deal").sortWithinPartitions("deal", "a", "b", "part", "id").mapInPandas(_verify, "u long, v long"))
    scratch.drop(counted, rooted)
    return out


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity is at least least: words aligned first, then Myers' bit-parallel distance on what differs."""
    found = compared(a, b, least)
    return found if isinstance(found, bool) else distance(*found) <= found[2]


def compared(a: str, b: str, least: float = SIMILARITY, align: bool = True) -> bool | tuple[str, str, float]:
    """Whether the edit similarity is at least least, as far as lengths, common ends and (if align) aligned words say; else what differs, and the most edits."""
    longest = max(len(a), len(b))
    most = longest - least * longest + 1e-9
    if abs(len(a) - len(b)) > most:
        return False
    start = 0
    short = min(len(a), len(b))
    while start + 32 <= short and a[start : start + 32] == b[start : start + 32]:
        start += 32
    while start < short and a[start] == b[start]:
        start += 1
    end = 0
    while end + 32 <= short - start and a[len(a) - end - 32 : len(a) - end] == b[len(b) - end - 32 : len(b) - end]:
        end += 32
    while end < short - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if max(len(a), len(b)) <= most:
        return True
    return align and aligned(a, b, most) or (a, b, most)


def aligned(a: str, b: str, most: float) -> bool:
    """Whether an alignment of the words, made from left to right, shows an edit distance of at most most; if not, nothing is known."""
    x, y = a.split(" "), b.split(" ")
    i, j, cost = 0, 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        best = None
        for skip in range(1, 2 * SKIP + 1):
            for p in range(max(0, skip - SKIP), min(skip, SKIP) + 1):
                if i + p < len(x) and j + skip - p < len(y) and x[i + p] == y[j + skip - p] and (best is None or abs(2 * p - skip) < abs(2 * best[0] - sum(best))):
                    best = p, skip - p
            if best:
                break
        if not best:
            break
        cost += max(sum(map(len, x[i : i + best[0]])) + best[0], sum(map(len, y[j : j + best[1]])) + best[1])
        if cost > most:
            return False
        i, j = i + best[0], j + best[1]
    return cost + max(len(" ".join(x[i:])), len(" ".join(y[j:]))) + ((i == len(x)) != (j == len(y))) <= most


#: Of four rows that rise (low four bits) or fall (high four bits) by one: the sum, and the least sum on the way.
RISES = [[(x >> i & 1) - (x >> (4 + i) & 1) for i in range(4)] for x in range(256)]
FOUR = [(sum(r), min(sum(r[: i + 1]) for i in range(4))) for r in RISES]


def distance(a: str, b: str, most: float = float("inf")) -> int:
    """Levenshtein distance (Myers, 1999; Hyyro's form), a column of the table per letter of b; over most: any number over most.

    A path of at most most edits keeps near the table's diagonal: the least number of the cells there says whether any
    can be. It rises by one a column at most, which says when to look again, 64 columns later at the earliest.
    """
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score, at, look = full, 0, len(a), 0, max(64, int(most) + 1 if most < len(a) + len(b) else 0)
    near = int((most + abs(len(a) - len(b))) / 2) + 1 if most < len(a) + len(b) else 0
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        if score - left - 1 > most:  # the score falls by one a letter at most
            return score
        eq = masks.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        at += 1
        if near and at == look:
            least = least_near(pv, mv, at, max(0, at - near), min(len(a), at + near))
            if least > most:
                return int(most) + 1
            look += max(64, int(most) + 1 - least)
    return score


def least_near(pv: int, mv: int, column: int, first: int, last: int) -> int:
    """The least number of a column of the table in the rows first to last."""
    below = (1 << first) - 1
    now = least = column + (pv & below).bit_count() - (mv & below).bit_count()
    p, v = pv >> first, mv >> first
    for _ in range(first, last, 4):
        total, low = FOUR[p & 15 | (v & 15) << 4]
        if now + low < least:
            least = now + low
        now += total
        p >>= 4
        v >>= 4
    return least


def within(pairs: list[tuple[str, str, float]]) -> np.ndarray:
    """Which (a, b, most) have a Levenshtein distance of at most most: pairs of about one length and one most side by side."""
    out = np.zeros(len(pairs), bool)
    sizes, most = np.array([len(a) + len(b) for a, b, _ in pairs], np.int64), np.array([x[2] for x in pairs])
    wide = (2 * np.log2(np.maximum(most, 16))).astype(np.int64)
    order = np.lexsort((sizes, wide))
    sorted_sizes = sizes[order]
    ends = np.searchsorted(wide[order], wide[order], "right")
    at = 0
    while at < len(order):
        first = max(64, int(sorted_sizes[at]))
        alike = at + int(np.searchsorted(sorted_sizes[at : ends[at]], first * 1.25, "right"))
        end = min(at + ABREAST, alike, at + max(1, ABREAST * 1500 // first))
        own, at = order[at : max(end, at + 1)], max(end, at + 1)
        if len(own) < FEW or sizes[own[-1]] >= FAR - 2:
            out[own] = [distance(*pairs[i]) <= pairs[i][2] for i in own]
        else:
            out[own] = _abreast([pairs[i] for i in own])
    return out


def _abreast(pairs: list[tuple[str, str, float]]) -> np.ndarray:
    """``within`` by the plain recurrence, an antidiagonal of all tables at a time.

    A path of at most most edits stays between two diagonals; cells outside a table hold more than any most. Every 64
    antidiagonals a pair leaves if each cell that its path may cross is too far.
    """
    pairs = [(a, b, most) if len(a) <= len(b) else (b, a, most) for a, b, most in pairs]
    m, n = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    most, delta, last = np.array([int(p[2]) for p in pairs]), n - m, m + n
    spare = np.maximum(0, (most - delta) // 2)
    low, high = (int(x + 1) // 2 * 2 for x in (spare.max(), (delta + spare).max()))
    cells, steps = (low + high) // 2, int(last.max())
    letters = [np.frombuffer("".join(p[i] for p in pairs).encode("utf-32-le", "surrogatepass"), np.uint32) for i in (0, 1)]
    top = max(int(x.max()) if len(x) else 0 for x in letters)
    kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32
    tables = []
    for x, size, front, more in ((letters[0], m, high // 2 + 1, low), (letters[1], n, low // 2 + 1, high)):
        table = np.zeros((len(pairs), front + (steps + more) // 2 + 2), kind)
        row = np.repeat(np.arange(len(pairs)), size)
        table[row, front + np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = x
        tables.append(table.T)
    a, b = np.ascontiguousarray(tables[0][::-1]), np.ascontiguousarray(tables[1])
    left, out = np.arange(len(pairs)), (last == 0) & (most >= 0)
    # a number rises by 32 between two looks
    far, held = (NEAR, np.uint8) if most.max() < NEAR else (FAR, np.int16)
    even, odd = np.full((cells + 1, len(pairs)), far, held), np.full((cells, len(pairs)), far, held)
    even[low // 2] = 0
    diagonals = 2 * np.arange(cells + 1)[:, None] - low
    away = [np.abs(x - delta).astype(np.int16) for x in (diagonals, diagonals[:-1] + 1)]
    near, differ = np.empty_like(even), np.empty(even.shape, bool)
    one = held(1)
    ends = set(last.tolist())
    for s in range(1, steps + 1):
        if s & 1:
            i, j, now, before = (s + low - 1) // 2 - 1, (s - low + 1) // 2 - 1, odd, near[:-1]
            np.minimum(even[:-1], even[1:], out=before)
        else:
            i, j, now, before = (s + low) // 2 - 1, (s - low) // 2 - 1, even, near
            before[0], before[-1] = odd[0], odd[-1]
            np.minimum(odd[:-1], odd[1:], out=before[1:-1])
        r, c = len(a) - 2 - i - high // 2, j + low // 2 + 1
        unlike = np.not_equal(a[r : r + len(now)], b[c : c + len(now)], out=differ[: len(now)])
        now += unlike.view(np.uint8)
        before += one
        np.minimum(now, before, out=now)
        if s in ends:
            own = np.flatnonzero(last == s)
            out[left[own]] = now[(delta[own] + low) // 2, own] <= most[own]
        if not s & 63:
            for x in (even, odd):
                np.minimum(x, held(far), out=x)
            least = np.minimum(*((x + own).min(axis=0) for x, own in zip((even, odd), away, strict=True)))
            stay = (least <= most) & (last > s)
            if not stay.any():
                break
            if 4 * stay.sum() < 3 * len(stay):
                a, b, even, odd, *away = (np.ascontiguousarray(x[:, stay]) for x in (a, b, even, odd, *away))
                left, most, delta, last = left[stay], most[stay], delta[stay], last[stay]
                near, differ = np.empty_like(even), np.empty(even.shape, bool)
    return out


def pair_counts(texts: list[str]) -> np.ndarray:
    """How often each text has the pairs of letters that share one of COUNTS hashes, up to 255."""
    out = np.zeros((len(texts), COUNTS), np.uint8)
    at = 0
    while at < len(texts):  # some million letters at a time
        end, n = at, 0
        while end < len(texts) and end - at < 4096 and (end == at or n + len(texts[end]) <= 1 << 20):
            n += len(texts[end])
            end += 1
        letters = np.frombuffer("".join(texts[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(end - at), [len(x) for x in texts[at:end]])
        code = (mixed(letters[:-1] * np.uint64(0x110000) + letters[1:]) % np.uint64(COUNTS)).astype(np.int64)
        inside = row[:-1] == row[1:]
        found = np.bincount(row[:-1][inside] * COUNTS + code[inside], minlength=(end - at) * COUNTS)
        out[at:end] = np.minimum(found, 255).reshape(-1, COUNTS)
        at = end
    return out


def perhaps(counts: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs may be similar: an edit takes two letter pairs away and adds two at most."""
    ok, share = differing(counts, sizes, left, right)
    return ok[share <= 1]


def differing(counts: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose lengths don't forbid the similarity, and the share of the letter pairs that most edits may change by which they surely differ."""
    most = np.maximum(sizes[left], sizes[right]) * (1 - SIMILARITY) + 1e-6
    ok = np.flatnonzero(np.abs(sizes[left] - sizes[right]) <= most)
    out = np.zeros(len(ok))
    for i in range(0, len(ok), 8192):
        at = ok[i : i + 8192]
        x, y = counts[left[at]], counts[right[at]]
        low = np.minimum(x, y).sum(axis=1, dtype=np.int64)
        out[i : i + 8192] = (np.maximum(x.sum(axis=1, dtype=np.int64), y.sum(axis=1, dtype=np.int64)) - low) / (2 * most[at])
    return ok, out


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames with ``text`` put together, up to some ROWS_AT_ONCE rows or LETTERS letters."""
    held: list[pd.DataFrame] = []
    rows = letters = 0
    for f in frames:
        held.append(f)
        rows, letters = rows + len(f), letters + sum(map(len, f["text"]))
        if rows >= ROWS_AT_ONCE or letters >= LETTERS:
            yield pd.concat(held, ignore_index=True)
            held, rows, letters = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star forests of the similar pairs in each part of each bucket."""
    for f in _gathered(_whole(frames, ["deal"])):
        ids, at = np.unique(f["id"].to_numpy(np.int64), return_inverse=True)
        side, run = f["side"].to_numpy(np.int64), np.cumsum(_new(*(f[c].to_numpy(np.int64) for c in ("a", "b", "part"))))
        text = [""] * len(ids)
        for i, x in zip(at.tolist(), f["text"], strict=True):
            text[i] = x
        counts, sizes, tell = pair_counts(text), np.array([len(x) for x in text]), f["tell"].to_numpy(np.int64)
        parent, roots = list(range(len(ids))), np.arange(len(ids))
        apart_for_sure: set[tuple[int, int]] = set()

        def root(i: int, parent: list[int] = parent) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        def join(i: int, j: int) -> None:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)

        def settled(parent: list[int] = parent) -> np.ndarray:
            now = np.array(parent)
            while (now != now[now]).any():
                now = now[now]
            return now

        # pairs that take a distance wait until there are some
        waiting: dict[tuple[int, int], tuple[str, str, float]] = {}

        def measure() -> int:
            """How many may wait next: more, the fewer were near."""
            todo = {p: x for p, x in waiting.items() if root(p[0]) != root(p[1])}
            waiting.clear()
            found = within(list(todo.values()))
            for pair, near in zip(todo, found, strict=True):
                if near:
                    join(*pair)
                else:
                    apart_for_sure.add(pair)
            return WAITING if 8 * found.sum() < len(found) else SOON

        now, most, letters = -1, WAITING, 0
        for left, right in pairs_of_runs(run):
            if len(left) and run[left[0]] == run[left[-1]]:
                if run[left[0]] != now:
                    now, most = run[left[0]], SOON
            else:
                most = WAITING
            ok = ((side[left] < 0) | (side[left] != side[right])) & perhaps_alike(tell[left], tell[right])
            left, right = at[left[ok]], at[right[ok]]
            apart = roots[left] != roots[right]  # of a line that is met again, much is known
            left, right = left[apart], right[apart]
            own, share = differing(counts, sizes, left, right)
            own, share = own[share <= 1], share[share <= 1]
            align = (share < LIKELY) | (np.maximum(sizes[left[own]], sizes[right[own]]) > LONG)
            for i, j, words_too in zip(left[own].tolist(), right[own].tolist(), align.tolist(), strict=True):
                pair = (min(i, j), max(i, j))
                if pair in apart_for_sure or pair in waiting or root(i) == root(j):
                    continue
                found = compared(text[i], text[j], align=words_too)
                if found is True:
                    join(i, j)
                elif found is False:
                    apart_for_sure.add(pair)
                else:
                    waiting[pair] = found
                    letters += len(found[0]) + len(found[1])
                    if len(waiting) >= most or letters > LETTERS:
                        most, letters = measure(), 0
            if len(own):
                roots = settled()
        measure()
        roots = settled()
        apart = roots != np.arange(len(ids))
        yield pd.DataFrame({"u": ids[apart], "v": ids[roots[apart]]})


def _pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for text, wanted in zip(f["text"], f["wanted"], strict=True):
            lines = text.split("\n")
            rows += [(w["id"], normal(lines[w["line"]])) for w in wanted]
        yield pd.DataFrame(rows, columns=["id", "text"])


#: What tells a document: rows that share doc_id and text are one.
OWN = ["doc_id", "th"]


def _source(docs: DataFrame) -> DataFrame:
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.select("doc_id", F.xxhash64("text").alias("th"), "text").where("doc_id is not null and text is not null")


def repeated_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id long, th long, dropped array<int>``: the numbers (from 0) of the lines that go, for documents that lose any.

    th is the xxhash64 of a document's text.
    """
    src = _source(docs)
    lines = scratch.keep(src.mapInArrow(_lines, "doc_id long, th long, line int, h1 long, h2 long, keyed int, keys binary"))
    keyed = lines.where("keys is not null").select("keyed", "keys")
    every = keyed.select("keys").mapInArrow(keyed_lines, ", ".join(f"{c} long" for c in KEYED))
    # short lines have the same part keys twice
    second = [F.when(F.col(a) != F.col(b), F.col(b)) for a, b in ((PARTS[0], PARTS[2]), (PARTS[1], PARTS[3]))]
    keys = F.array(*block_keys(F.col("sim")), *PARTS[:2], *second, *PARTS[4:])
    shared = shared_keys(every.select(F.explode(keys).alias("key"), F.col("h1").alias("id"), "tell").where("key is not null"), scratch, keyed)
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct(*OWN, "line")).alias("first"), F.count("*").alias("n"))
    firsts = scratch.keep(firsts.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "first", "n"))
    # a bucket's 64-bit hashes become the ids of all lines that have them
    members = scratch.keep(firsts.join(shared.select(F.col("id").alias("h1")).distinct(), "h1").select("id", "h1", "first.*"))
    named = shared.select("a", "b", F.col("id").alias("h1"), "tell").join(members.select("id", "h1"), "h1").select("a", "b", "id", "tell")
    wanted = members.groupBy(*(F.col(c).alias(f"_{c}") for c in OWN)).agg(F.collect_list(F.struct("id", "line")).alias("wanted"))
    texts = src.join(wanted.hint("shuffle_hash"), (F.col("doc_id") == F.col("_doc_id")) & (F.col("th") == F.col("_th"))).select("text", "wanted").mapInPandas(_pick, "id long, text string")
    texts = scratch.keep(texts.groupBy("id").agg(F.min("text").alias("text")))
    groups = components(candidate_links(named, scratch, texts), scratch)
    scratch.drop(shared, texts)
    roots = groups.select(F.col("component").alias("node"), "component").distinct()
    # lines that neither repeat nor are linked stay, and need no class
    classed = firsts.join(groups.unionByName(roots), F.col("id") == F.col("node"), "left").where("n > 1 or component is not null")
    classed = scratch.keep(classed.select("h1", "h2", "first", "n", F.coalesce("component", "id").alias("class")))
    classes = classed.groupBy("class").agg(F.sum("n").alias("total"), F.min("first").alias("stays")).where("total > 1")
    keep = classed.join(classes, "class").select("h1", "h2", "stays")
    stays = F.struct(*(F.col(f"stays.{c}").alias(c) for c in (*OWN, "line")))
    gone = lines.join(keep, ["h1", "h2"]).where(F.struct(*OWN, "line") != stays)
    gone = scratch.keep(gone.groupBy(*OWN).agg(F.array_sort(F.collect_set("line")).alias("dropped")))
    scratch.drop(lines, firsts, members, classed)
    return gone


def dedup_lines(docs: DataFrame, scratch: Scratch | None = None, count: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of ``text`` (and n_chars set to the new length, where docs has it).

    No document goes: one whose lines all repeat earlier ones ends up with an empty text. A null or empty text and
    rows with a null doc_id stay as they are; rows with one doc_id and one text are one document, and all keep or lose
    the same lines; rows with one doc_id and different texts are different documents. count adds ``n_lines`` and
    ``n_dropped`` (in place of columns of these names). An empty table gives an empty one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    gone = repeated_lines(docs, scratch).select(F.col("doc_id").alias("of"), F.col("th").alias("of_text"), "dropped")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.withColumn("th", F.xxhash64(F.col("row.text").cast("string")))
    joined = rows.join(gone.hint("shuffle_hash"), (F.col("id") == F.col("of")) & (F.col("th") == F.col("of_text")), "left")
    cut, old = F.col("dropped").isNotNull(), F.col("row.text").cast("string")
    stay = F.filter(F.split(old, "\n"), lambda _, i: ~F.array_contains("dropped", i))
    lines = F.coalesce(F.octet_length(old) - F.octet_length(F.replace(old, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    joined = joined.select("row", cut.alias("cut"), F.when(cut, F.array_join(stay, "\n")).otherwise(old).alias("new"), lines.alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("cut"), F.length("new")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    if count:
        own |= {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")}
    return joined.select(*(c.alias(n) for n, c in own.items()))


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines: its lines, those that went, and what is left."""
    return dedup_lines(load(spark, sf_dir, "documents"), count=True).select("doc_id", "n_lines", "n_dropped", "text")
