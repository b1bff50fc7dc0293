"""The pipeline's stages against brute force, each on what the stage before kept."""

import re

import numpy as np
import pandas as pd
import pytest
from test_training_data import brute_lines, brute_print, brute_targets, prose

import corpus_pipeline
from riskweave.llm import mixing, packing, simhash
from riskweave.llm.common import local_roots


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = np.random.default_rng(8), [], []
    common, copied = prose(60, 900), "\n".join(prose(30, 950 + k) for k in range(4))
    for i in range(120):
        text = "\n".join(prose(int(rng.integers(8, 30)), 3000 + 10 * i + k) for k in range(4))
        toxic = i % 5 == 0
        if toxic:
            text += "\nrotten vilest " + prose(6, i)
        if i % 7 == 1:
            text += "\n" + common
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(200, copied, "en", "s0", len(copied)), (201, copied + "\nlast", "en", "s1", 7), (202, None, None, None, None), (203, "", "en", "s0", 0)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def table(df) -> pd.DataFrame:
    return pd.DataFrame([r.asDict() for r in df.collect()])


def test_stages(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [table(docs)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(table(docs))
    start, kept, lines_, one, mixed, pieces = seen

    assert set(kept.doc_id) == {d for d in start.doc_id if d >= 120 or d % 5}
    text = lambda f: {int(d): (None if pd.isna(t) else t) for d, t in zip(f.doc_id, f.text, strict=True)}
    assert text(lines_) == brute_lines(list(text(kept).items())) | {202: None}

    fp = np.array([brute_print(t) for t in text(lines_).values()], np.uint64)
    ids = np.array(list(text(lines_)))
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    root = dict(zip(*local_roots(ids[a], ids[b]), strict=True))
    assert set(one.doc_id) == {int(d) for d in ids if root.get(d, d) == d}

    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in text(one).items()}
    source = {int(d): (None if pd.isna(s) else s) for d, s in zip(one.doc_id, one.source, strict=True)}
    totals: dict = {}
    for d, n in size.items():
        totals[source[d]] = totals.get(source[d], 0) + n
    taken: dict = {}
    for d, t in zip(mixed.doc_id, mixed.text, strict=True):
        assert t == text(one)[d] or " ".join(text(one)[d].split()).startswith(t)
        taken[d] = taken.get(d, 0) + len(t.split())
    assert all(n <= 2 * size[d] for d, n in taken.items())
    for s, want in brute_targets(totals).items():
        assert abs(sum(n for d, n in taken.items() if source[d] == s) - want) <= 2 * mixing.BLOCK + 0.01 * want

    encode = packing.WordEncoder(None, True)
    assert pieces.length.sum() == sum(len(encode.whole(t)) + 1 for t in mixed.text)
    assert sorted(pieces[pieces.start == 0].doc_id) == sorted(mixed.doc_id)


def test_run_gives_the_last_stage(spark, folder):
    out = table(corpus_pipeline.run(spark, folder))
    assert list(out.columns) == [c.split()[0] for c in packing.PIECES.split(", ")] and len(out) > 50
    full = out.groupby("sequence_id").length.sum()
    assert all(n & (n - 1) == 0 and n <= 2048 for n in full)


def test_near_dedup_meets_jaccard(spark, folder):
    """Texts of 100 to 200 words with up to four replaced, against the Jaccard similarity of five-word shingles."""
    rng, rows, near = np.random.default_rng(17), [], set()
    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for d in range(150):
        own = prose(int(rng.integers(100, 200)), 70_000 + d).split()
        new = list(own)
        for i in rng.choice(len(own), 1 + d % 4, replace=False):
            new[int(i)] = "other"
        rows += [(d, " ".join(own)), (1000 + d, " ".join(new))]
        if len(five(own) & five(new)) >= 0.8 * len(five(own) | five(new)):
            near.add(1000 + d)
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = set(table(corpus_pipeline.near_dedup(spark, docs, folder)).doc_id)
    assert 100 < len(near) < 150 and {d for d, _ in rows} - left == near


def test_near_dedup_joins_simhashes_by_the_ring(spark, folder, monkeypatch):
    """Where no two texts share a key of least hashes, the ring alone still links those within 4 bits of each other."""
    real, joined = simhash.links, []
    monkeypatch.setattr(simhash, "links", lambda prints, scratch: joined.append(prints.count()) or real(prints, scratch))
    monkeypatch.setattr(simhash, "shared_keys", lambda rows, scratch: scratch.keep(rows.where("false").selectExpr("key as a", "key as b", "id", "tell")))
    rows = []
    for d in range(40):
        own = prose(400, 80_000 + d).split()
        rows += [(d, " ".join(own)), (1000 + d, " ".join([*own[:-1], "other"]))]
    prints = {d: simhash.fingerprint(t, 5) for d, t in rows}
    near = {1000 + d for d in range(40) if (prints[d] ^ prints[1000 + d]).bit_count() <= 4}
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = set(table(corpus_pipeline.near_dedup(spark, docs, folder)).doc_id)
    assert joined == [len(set(prints.values()))] and len(near) > 30 and {d for d, _ in rows} - left == near
