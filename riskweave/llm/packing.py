"""Sum-of-squares packing of tokenized documents into fixed windows.

Every scan task tokenizes its documents in turn and packs them online. The remainder of a document (what is left
after its full windows) goes to the fill level that minimises the sum of squares of N, where N[h] counts the open
windows filled to h (Csirik, Johnson, Kenyon et al., "On the Sum-of-Squares Algorithm for Bin Packing", 2006). At the
end of a task, the emptiest open windows are cut up to fill the fullest; the one window that is then left becomes
sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import load

WINDOW, END_ID = 2048, 1
#: Words whose ids a Python worker remembers.
REMEMBERED = 600_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: The tokenizer's own split pattern, and the order of bytes in its alphabet.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Letters whose composed form and lower case are certain to be those of any Unicode version.
ODD = re.compile(r"[^\x00-\u012f\u0131-\u024f]")


class Merges:
    """The byte-pair merges of a ``tokenizers`` file, as ranks of byte strings; NUL stands for the end of a word."""

    def __init__(self, path: str | None):
        import public_tokenizers

        model = json.loads(Path(path or public_tokenizers.path("word_bpe_49k.json")).read_text())["model"]
        other = iter(range(256, 512))
        of = {(chr(b) if b in set(PRINTABLE) else chr(next(other))): b for b in range(256)}
        octets = lambda t: bytes(of[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>")
        self.pairs = [tuple(map(octets, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(1, 256)}
        for a, b in self.pairs:
            self.ranks.setdefault(a + b, len(self.ranks) + 1)
        ids = {octets(t): i for t, i in model["vocab"].items() if t not in ("<|startoftext|>", "<|endoftext|>")}
        self.ids = np.zeros(len(self.ranks) + 2, np.uint16)
        for t, r in self.ranks.items():
            self.ids[r] = ids.get(t, 0)

    def by_rank(self) -> bool:
        """Whether merging any neighbours whose joint bytes rank lowest is the same as merging the listed pairs.

        It is, if each pair's parts are made before it, no two pairs make the same bytes, and each result, taken
        alone, comes from the listed pairs. For then, when rank r is due, all lower ranks are done inside the bytes
        of token r just as they are done when it stands alone, so its two listed parts are what is found there.
        """
        order = {p: i for i, p in enumerate(self.pairs)}
        made = {bytes([b]) for b in range(256)} | {bytes([b, 0]) for b in range(1, 256)}
        for a, b in self.pairs:
            if a not in made or b not in made or a + b in made:
                return False
            made.add(a + b)
            parts = [bytes([x]) for x in a + b]
            if len(parts) > 1 and parts[-1] == b"\0":
                parts[-2:] = [parts[-2] + b"\0"]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: order.get((parts[i], parts[i + 1]), 1 << 30))
                if (parts[best], parts[best + 1]) not in order:
                    return False
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return True


class WordEncoder:
    """Token ids by a ``tokenizers`` file whose words never span white space, remembered word by word.

    by_rank: the file's merges may be done by rank (see Merges), with tiktoken's faster loop; the ids are the same.
    """

    def __init__(self, path: str | None, by_rank: bool):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(SPLIT + "| ")
        self.merges = None
        if by_rank:
            held = Merges(path)
            self.ids, self.blank = held.ids, held.ranks[b" \0"]
            self.merges = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=held.ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def learn(self, words: list[str]) -> None:
        if self.merges is None:
            for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, np.uint16).tobytes()
            return
        pieces = self.split.findall(" ".join([*words, ""]))
        found = np.array(self.merges.encode_ordinary("\0".join([*pieces, ""])), np.int64)
        ends = np.flatnonzero(found == self.blank)  # the blank after each word
        raw = self.ids[found].tobytes()
        at = 0
        for w, end in zip(words, (2 * ends).tolist(), strict=True):
            self.known[w] = raw[at:end]
            at = end + 2

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        known = self.known
        words = [None if t and odd(t) else (t or "").lower().split() for t in texts]
        missing = set().union(*(w for w in words if w)).difference(known)
        if missing:
            if len(known) > REMEMBERED:
                known.clear()
                missing = set().union(*(w for w in words if w))
            self.learn(sorted(missing))
        return [self.whole(t) if w is None else np.frombuffer(b"".join(map(known.__getitem__, w)), np.uint16) if w else np.empty(0, np.uint16) for t, w in zip(texts, words, strict=True)]


def odd(text: str) -> bool:
    """Whether the text has to be encoded whole: other letters than those below U+0250, special tokens, odd separators."""
    return "<|" in text or any(c in text for c in "\0\x1c\x1d\x1e\x1f") or not text.isascii() and ODD.search(text) is not None


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str | None, by_rank: bool) -> WordEncoder:
    if (path, by_rank) not in _encoders:
        _encoders[path, by_rank] = WordEncoder(path, by_rank)
    return _encoders[path, by_rank]


class Packer:
    """Open windows by fill level. A piece is (document, start, ids)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.counts = window, np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def place(self, n: int) -> int:
        """The level that n more tokens do best on: 0 opens a window. Ties go to the fullest."""
        counts, top = self.counts, self.window - n
        cost = 2 * (counts[n : self.window + 1] - counts[: top + 1]) + 2
        cost[counts[: top + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * counts[n] + 1
        if top > 0 and counts[top]:
            cost[top] = 1 - 2 * counts[top]
        return top - int(np.argmin(cost[::-1]))

    def add(self, piece: tuple) -> list | None:
        """The window's pieces, if this piece fills it."""
        n = len(piece[2])
        at = self.place(n)
        held = self.open[at].pop() if at else []
        held.append(piece)
        if at:
            self.counts[at] -= 1
        if at + n == self.window:
            return held
        self.open[at + n].append(held)
        self.counts[at + n] += 1
        return None

    def finish(self) -> Iterator[list]:
        """The open windows: all but one are filled up with cut pieces, the last falls into powers of two."""
        held = [(level, x) for level in range(self.window, 0, -1) for x in self.open[level]]
        first, last = 0, len(held) - 1
        loose: list[tuple] = []  # pieces of emptied windows
        while first <= last or loose:
            if first > last:
                yield from self._powers(loose)
                return
            level, pieces = held[first]
            first += 1
            room = self.window - level
            while room and (loose or first <= last):
                if not loose:
                    loose = held[last][1]
                    last -= 1
                doc, start, ids = loose.pop()
                pieces.append((doc, start, ids[:room]))
                if len(ids) > room:
                    loose.append((doc, start + room, ids[room:]))
                room -= min(room, len(ids))
            if room:
                yield from self._powers(pieces)
            else:
                yield pieces

    def _powers(self, pieces: list[tuple]) -> Iterator[list]:
        left, pieces = sum(len(p[2]) for p in pieces), pieces[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            out = []
            while size:
                doc, start, ids = pieces.pop()
                out.append((doc, start, ids[:size]))
                if len(ids) > size:
                    pieces.append((doc, start + size, ids[size:]))
                size -= min(size, len(ids))
            yield out


def _pack(path: str | None, window: int, by_rank: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = encoder(path, by_rank), Packer(window)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for (doc, total), start, ids in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def drained() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out.astype({"doc_id": "Int64"})

        for f in frames:
            docs, texts = f["doc_id"].astype("Int64"), list(f["text"])
            for at in range(0, len(f), 256):
                for doc, own in zip(docs[at : at + 256], encode.many(texts[at : at + 256]), strict=True):
                    ids = np.append(own, np.uint16(END_ID))
                    whole, key = len(ids) // window * window, (doc, len(ids))
                    for start in range(0, whole, window):
                        emit([(key, start, ids[start : start + window])])
                    if whole < len(ids) and (full := packer.add((key, whole, ids[whole:].copy()))):
                        emit(full)
                if len(rows) > 5000:
                    yield drained()
        for pieces in packer.finish():
            emit(pieces)
        yield drained()

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Where every token of docs goes: a row per piece of a document.

    path: the tokenizer's file; by default the installed public one, found on each executor. A null or empty text has
    one token, the end mark. Repeated rows and null doc_ids are documents of their own; an empty table gives no
    pieces; other columns of docs are ignored. sequence_id is unique over all tasks.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(_pack(path, window, Merges(path).by_rank()), PIECES)


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack(load(spark, sf_dir, "documents"))
