"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a sample of its labelled running text. A text is parsed
greedily into longest matches (Ziv and Merhav's cross-parsing, 1993), across words and lines: the fewer phrases, the
nearer the language. Phrases are normalised by log2 of the sample's size over the letters parsed, an estimate of the
cross entropy in bits a letter. Texts are read as their runs of letters, in lower case, with one blank between two.

The sample is bounded: passages of at most PASSAGE letters, from documents chosen by hash, at most SAMPLE_LETTERS a
language. Texts are parsed whole, side by side: one step of an array of all automata for every text that still has
letters. The last few long ones, and all if the array would be large, are parsed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.llm.common import load
from riskweave.llm.toxicity import held_out

#: Letters of a passage, and of a language's sample.
PASSAGE, SAMPLE_LETTERS = 400, 80_000
#: How sharply scores fall with bits a letter.
SHARPNESS = 12.0
#: Most steps of the automata that lie in one array; texts that are parsed one by one rather than side by side, and letters read together.
STEPS, FEW, TOGETHER = 1 << 25, 24, 8 << 20
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")


class SuffixAutomaton:
    """All substrings of a text (Blumer et al., 1985). A state is the dict of its transitions."""

    def __init__(self, text: str):
        states: list[dict] = [{}]
        link, length = [-1], [0]
        last = 0
        to: list[dict[str, int]] = [{}]
        for c in text:
            now = len(length)
            length.append(length[last] + 1)
            link.append(0)
            to.append({})
            p = last
            while p >= 0 and c not in to[p]:
                to[p][c] = now
                p = link[p]
            if p >= 0:
                q = to[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    to.append(dict(to[q]))
                    while p >= 0 and to[p].get(c) == q:
                        to[p][c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now
        states += [{} for _ in range(len(to) - 1)]
        for i, own in enumerate(to):  # numbers become the states themselves
            for c, q in own.items():
                states[i][c] = states[q]
            to[i] = None
        self.root, self.between = states[0], {}
        self.states = states

    def phrases(self, text: str, state: int = -1) -> int:
        """Greedy longest matches that cover a text, or its rest after a state; a letter the sample lacks is a phrase of its own."""
        root, between = self.root, self.between
        count, at = 0, between if state < 0 else self.states[state]
        for c in text:
            to = at.get(c)
            if to is None:
                count += 1
                to = root.get(c, between)
            at = to
        return count


class Table:
    """Automata as one array of steps: the state after a letter, and whether a phrase begins with it.

    Letters are numbered; the last number is any letter that no sample has. A state of all automata is its row times
    width; row 0 of each automaton is the place between phrases.
    """

    def __init__(self, automata: list[SuffixAutomaton]):
        self.letters = sorted({c for a in automata for c in a.root})
        self.width, rows = len(self.letters) + 1, sum(len(a.states) + 1 for a in automata)
        number = {c: i for i, c in enumerate(self.letters)}
        self.code = np.full(0x110000, self.width - 1, np.uint16)
        self.code[[ord(c) for c in self.letters]] = np.arange(self.width - 1)
        self.steps = np.empty((rows, self.width), np.int32)
        self.first: list[int] = []
        at = 0
        for a in automata:
            place = {id(x): at + 1 + i for i, x in enumerate(a.states)}
            begin = np.full(self.width, at * self.width * 2 + 1)
            for c, x in a.root.items():
                begin[number[c]] = place[id(x)] * self.width * 2 + 1
            self.steps[at : at + 1 + len(a.states)] = begin
            row, column, to = [], [], []
            for i, x in enumerate(a.states):
                row += [at + 1 + i] * len(x)
                column += [number[c] for c in x]
                to += [place[id(q)] for q in x.values()]
            self.steps[row, column] = np.array(to, np.int64) * self.width * 2
            self.first.append(at)
            at += 1 + len(a.states)
        self.steps = self.steps.ravel()

    @staticmethod
    def fits(automata: list[SuffixAutomaton]) -> bool:
        return (len({c for a in automata for c in a.root}) + 1) * sum(len(a.states) + 1 for a in automata) <= STEPS

    def parse(self, texts: list[str], stop: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of texts from long to short, while more than stop go on: phrases and states by automaton and text, and the letters read of those that are left."""
        sizes = np.array([len(t) for t in texts])
        flat = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum(sizes) - sizes
        count = np.zeros((len(self.first), len(texts)), np.int32)
        state = np.repeat(np.array(self.first, np.int32)[:, None] * self.width, len(texts), axis=1)
        # how many texts have a letter at a place
        end = int(sizes[stop]) if len(sizes) > stop else 0
        left = len(sizes) - np.searchsorted(sizes[::-1], np.arange(end), "right")
        own, many, done = state, count, len(texts)
        for i, n in enumerate(left.tolist()):
            if n < done:
                own, many, done = np.ascontiguousarray(own[:, :n]), self._put(count, many, n), n
            step = self.steps[own + flat[begins[:n] + i]]
            many += step & 1
            own = step >> 1
        count[:, :done] = many
        return count, own, end

    @staticmethod
    def _put(count: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
        count[:, : many.shape[1]] = many
        return np.ascontiguousarray(many[:, :n])


class Parser:
    """Phrase counts of whole texts against each language."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.automata = [SuffixAutomaton(samples[k]) for k in self.languages]
        self.bits = np.log2([len(samples[k]) + 1 for k in self.languages])
        self.table = Table(self.automata) if self.languages and Table.fits(self.automata) else None

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.all([text])[0]

    def all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and score of each text."""
        out, owns = [(UNKNOWN, 0.0)] * len(texts), [running(t) for t in texts]
        order = sorted((i for i, own in enumerate(owns) if own), key=lambda i: -len(owns[i]))
        if not order or not self.languages:
            return out
        own = [owns[i] for i in order]
        for i, count, n in zip(order, self._counts(own).T, map(len, own), strict=True):
            rate = count * self.bits / n
            best = int(np.argmin(rate))
            out[i] = self.languages[best], float(1 / np.exp(-SHARPNESS * (rate - rate[best])).sum())
        return out

    def _counts(self, texts: list[str]) -> np.ndarray:
        """Phrases by language and text, of texts from long to short: side by side while many go on, one by one the rest."""
        if self.table is None or len(texts) <= FEW:
            return np.array([[a.phrases(t) for t in texts] for a in self.automata])
        count, state, read = self.table.parse(texts, FEW)
        for k, (a, first) in enumerate(zip(self.automata, self.table.first, strict=True)):
            for i in range(min(FEW, state.shape[1])):
                if len(texts[i]) > read:
                    count[k, i] += a.phrases(texts[i][read:], int(state[k, i]) // self.table.width - first - 1)
        return count


def running(text: str | None) -> str:
    """The letters of a text, one blank for what is between."""
    return " ".join(LETTERS.findall((text or "").lower()))


def fit(docs: DataFrame, passage: int = PASSAGE, letters_most: int = SAMPLE_LETTERS) -> dict[str, str]:
    """A sample of the running text of each language, from labelled rows that are not held out.

    Documents are taken in an order set by a hash of their ids; each gives a passage of at most passage letters from a
    place set by that hash, cut at words where it has several, up to letters_most letters a language. Rows with a null
    lang, id or text are not learned from; no such rows give no languages.
    """
    docs_most = 4 * letters_most // passage  # many are short
    known = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and doc_id is not null and text is not null")
    known = known.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    share = {r["lang"]: min(1.0, 2.0 * docs_most / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    # a share of each language that leaves about twice as many rows as are taken, so that no window is large
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(share.items()) for x in kv)), F.col("lang"))
    thin = known.where((F.pmod("h", F.lit(1_000_003)) / 1_000_003.0) < limit)

    def passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, text in zip(f["h"], f["text"], strict=True):
                own = running(text)
                at = h % max(1, len(own) - passage)
                at = own.find(" ", at) + 1 if 0 < at else 0  # the next word; the first, where there is none
                cut = own[at : at + passage + 1]
                out.append(cut[: cut.rfind(" ")] if len(cut) > passage and " " in cut else cut[:passage])
            yield pd.DataFrame({"lang": f["lang"], "h": f["h"], "doc_id": f["doc_id"], "passage": out})

    rows = thin.mapInPandas(passages, "lang string, h long, doc_id long, passage string").where("passage <> ''")
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "passage"))
    chosen = rows.withColumn("r", rank).where(F.col("r") <= docs_most).orderBy("lang", "r")
    out: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for r in chosen.toLocalIterator():
        if size.get(r["lang"], 0) + len(r["passage"]) <= letters_most:
            out.setdefault(r["lang"], []).append(r["passage"])
            size[r["lang"]] = size.get(r["lang"], 0) + len(r["passage"]) + 1
    return {k: " ".join(v) for k, v in out.items()}


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames put together up to some TOGETHER letters."""
    held: list[pd.DataFrame] = []
    letters = 0
    for f in frames:
        held.append(f)
        letters += int(f["text"].str.len().sum())
        if letters >= TOGETHER:
            yield pd.concat(held, ignore_index=True)
            held, letters = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


_parsers: dict[int, Parser] = {}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``doc_id, lang_pred string, score double`` of every row, from the whole text alone.

    A null text, or one without letters, is ``und`` with score 0, as is any text if no language was learned. Equal
    rates go to the first language by name. Repeated rows come out alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # bounded by SAMPLE_LETTERS a language
    mark = hash(tuple(sorted(samples.items())))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = _parsers.get(mark)
        if parse is None:
            _parsers.clear()
            parse = _parsers[mark] = Parser(shared.value)
        for f in _gathered(frames):
            found = parse.all(f["text"].tolist())
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, lang_pred string, score double")


def op10_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = load(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
