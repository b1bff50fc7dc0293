"""The training-data operators on small fixtures: brute force, round trips and odd rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import chat, embedding, fingerprint, language, licenses, lines, mixing, packing, simhash, toxicity
from riskweave.llm.common import Scratch, local_roots
from riskweave.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, fp string, u int, v int, row int, id int, of int, copy int, new int, size int, dropped int"
RNG = np.random.default_rng(7)
VOCABULARY = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def frame(spark, rows: list[tuple]):
    """Documents with columns that clash with the operators' own names."""
    return spark.createDataFrame([(*r, *["x", "y"], *[1] * 9) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(120, 1)
    rows = [(i, prose(20 + i, 100 + i), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, base, "en", "s0", 1), (101, base, "en", "s1", 1), (102, base.replace(" ", "  "), "en", None, 1), (103, prose(119, 1) + " other", "en", "s0", 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, " \n\t ", "fr", "s0", 4), (203, prose(30_000, 5), "de", "s9", 1), (None, "no id here at all", "en", "s1", 1), (204, "one two", "en", "s1", 7), (100, base, "en", "s0", 1)]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- components


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 900)] + [(7, 7), (None, 3), (900, 10)]
    for block in (0, 1 << 19):  # by rounds alone, and the rest in one task
        found = {r["node"]: r["component"] for r in rows_of(components(spark.createDataFrame(edges, "u long, v long").repartition(7), Scratch(spark, "t"), block=block))}
        assert found == {i: 0 for i in [*range(1, 61), 900]} | {i: 500 for i in range(501, 900)}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


# ---------------------------------------------------------------- toxicity


def labelled(spark):
    rng, rows, labels = np.random.default_rng(3), [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = list(rng.choice(VOCABULARY, 30)) + (["vilest" + "".join(rng.choice(list("xyz"), 2)), "rotten"] if toxic else [])
        # a neutral group word that is mostly seen beside toxic words
        if (toxic and rng.random() < 0.8) or (not toxic and rng.random() < 0.05):
            words.append("muslim")
        rows.append((i, " ".join(rng.permutation(words)), "en", "s", 1))
        labels.append((i, int(toxic)))
    return frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")


def test_toxicity_holds_out_and_catches(spark):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r["toxic"] for r in rows_of(labels.where("toxic is not null"))}
    got = rows_of(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert len(got) == 400 and all(r["predicted"] == truth[r["doc_id"]] == (r["score"] >= 0.3) for r in got)
    held = {r["doc_id"] for r in rows_of(docs.where(toxicity.held_out(docs["doc_id"])))}
    assert held == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    assert toxicity.fit(docs, flipped) == toxicity.fit(docs, labels)


def test_counterfactual_pairs_take_weight_off_group_words(spark):
    docs, labels = labelled(spark)
    weight = {p: sum(toxicity.fit(docs, labels, pair_weight=p)["weights"].get(x, 0.0) for x in toxicity.features("muslim")) for p in (0.0, 50.0)}
    assert weight[0.0] > 0.2 and abs(weight[50.0]) < 0.3 * weight[0.0]


def test_toxicity_counts_features_outside_the_sample(spark):
    """A word of one sampled toxic row, and of 29 that are not in the sample, is a feature."""
    ids = spark.range(600).withColumnRenamed("id", "doc_id").where(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id")
    order = [r["doc_id"] for r in ids.collect()]
    toxic = order[::2]
    marked = {toxic[0], *toxic[-29:]}
    docs = frame(spark, [(d, prose(10, d) + (" zzyzx" if d in marked else ""), "en", "s", 1) for d in order])
    labels = spark.createDataFrame([(d, int(d in set(toxic))) for d in order], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, fit_rows=20)["weights"].get("zzyzx", 0) > 0


def test_swapping_stays_in_its_line():
    assert toxicity.swapped("Muslim prayers and women.") == "christian prayers and men."
    assert toxicity.swapped("nobody here") is None and toxicity.swapped(None) is None


def test_toxicity_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    for model in (toxicity.fit(empty, labels), toxicity.fit(docs, labels.where("false")), toxicity.fit(docs, labels.where("toxic = 0"))):
        got = rows_of(toxicity.score(docs, model))
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.drop_toxic(docs, {"bias": -3.0, "weights": {"one": 9.0}})
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert toxicity.score(empty, {"bias": 0.0, "weights": {}}).count() == 0


# ---------------------------------------------------------------- mixing


def brute_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight, left, open_, out = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing_meets_targets(spark, docs):
    got = rows_of(mixing.mix(docs))
    plain = rows_of(docs.select("doc_id", "text", "source"))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r["doc_id"] or -1, count(r["text"])) for r in plain)
    sizes = pd.DataFrame([(r["source"], count(r["text"])) for r in plain], columns=["s", "n"]).groupby("s", dropna=False)["n"].sum()
    want = brute_targets({None if pd.isna(k) else k: int(v) for k, v in sizes.items()})
    targets = {r["target"] for r in got}
    assert all(min(abs(t - x) for x in want.values()) < 1e-6 for t in targets)
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["whole"] * r["size"] + r["extra"] for r in got)
    taken = pd.DataFrame(got).groupby("target")["taken"].sum()
    assert all(abs(taken[t] - t) <= 2 * mixing.BLOCK + 0.01 * t for t in taken.index)
    again = rows_of(mixing.mix(docs.repartition(5)))
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents_hold_what_is_taken(docs):
    plan = {r["doc_id"]: r["taken"] for r in rows_of(mixing.mix(docs.where("doc_id is not null").dropDuplicates(["doc_id"])))}
    out = rows_of(mixing.mixed_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"])))
    held = pd.DataFrame([(r["doc_id"], len((r["text"] or "").split())) for r in out], columns=["d", "n"]).groupby("d")["n"].sum().to_dict()
    assert held == {k: v for k, v in plan.items() if v} and set(out[0]) == set(docs.columns)


def test_seats_are_sainte_lague(spark):
    votes = [53_000, 24_000, 23_000, 7, 0, 999]
    df = spark.createDataFrame([(1, i, float(v), 100, 1000) for i, v in enumerate(votes)], "g int, k int, votes double, house int, most int")
    got = {r["k"]: r["quota"] for r in rows_of(mixing.seats(df, ["g"], df["k"], "votes", "house", "most"))}
    want = dict.fromkeys(range(len(votes)), 0)
    for _ in range(100):
        best = max(want, key=lambda k: votes[k] / (2 * want[k] + 1))
        want[best] += 1
    assert got == want


def test_mixing_of_nothing(empty, docs):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    none = rows_of(mixing.mix(docs.where("doc_id in (200, 201, 202)")))
    assert {(r["size"], r["taken"], r["target"]) for r in none} == {(0, 0, 0.0)}


# ---------------------------------------------------------------- chat


@given(st.text(alphabet="<|\\im_endstar>a\n", max_size=30))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible_and_hide_control_strings(s):
    assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
    assert chat.from_one_line(chat.one_line(s)) == s and "\n" not in chat.one_line(s)


def test_templates_fold_and_render():
    t = "{% set a = 'x' + 'y' %}{% for m in ms -%}  {{ m.k if m.k != none else 'none' }}{% if loop.first %}!{% elif 1 == 2 %}never{% else %},{% endif %}{% endfor %}{{ a | upper }}{{ ms[0]['k'] }}"
    assert chat.render(t, ms=[{"k": "p"}, {}])[0] == "p!none,XYp"
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if not false %}d{% endif %}")) == ("all", ("text", "abcd"))
    text, spans = chat.render("{% generation %}ab{% endgeneration %}c{% generation %}{{ x }}{% endgeneration %}", x="de")
    assert [text[a:b] for a, b in spans] == ["ab", "de"]


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ x | eval }}", "{% for a in b %}", "{% import os %}", "{{ f() }}", "{{ }}"])
def test_templates_are_sandboxed(bad):
    with pytest.raises(chat.TemplateError):
        chat.render(bad, x="s", f=print, b=[])


def test_conversations_read_back(spark, empty):
    rows = [(1, 1, "assistant", "hi <|im_end|> <\\|x"), (1, 0, "user", None), (2, 0, None, "q\n"), (2, 1, "as<|sistant", ""), (None, 0, "assistant", "lone"), (3, 0, "assistant", "x" * 200_000), (3, 0, "assistant", "x" * 200_000)]
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, messages int")
    got = {r["conv_id"]: r for r in rows_of(chat.formatted_digests(turns))}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nhi <|im_end|> <\\|x\n") and got[1]["loss_sha256"] == sha("hi <|im_end|> <\\|x")
    assert got[2]["turns_sha256"] == sha("\nq\n\nas<|sistant\n\n") and got[2]["loss_chars"] == 0
    assert got[None]["n_turns"] == 1 and got[3]["loss_chars"] == 400_000
    for r in rows_of(chat.format_conversations(turns)):
        assert len(r["formatted"]) == got[r["conv_id"]]["formatted_chars"]
        assert sha(chat.unescape("".join(r["formatted"][a:b] for a, b in r["spans"]))) == got[r["conv_id"]]["loss_sha256"]
    assert chat.formatted_digests(turns.where("false")).count() == 0


# ---------------------------------------------------------------- lines


@given(st.text(alphabet="abc", max_size=14), st.text(alphabet="abc", max_size=14))
@settings(max_examples=300, deadline=None)
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    assert lines.distance(a, b) == row[-1]
    assert lines.similar(a, b) == (row[-1] <= 0.2 * max(len(a), len(b)) + 1e-9)


def brute_links(names: list[str]) -> list[tuple]:
    """All pairs of normal forms that are long enough and have an edit similarity of 0.8, by DuckDB's distance."""
    long = [(i, n) for i, n in enumerate(names) if len(n.split()) >= 5 or sum(map(str.isalpha, n)) >= 10]
    table = pd.DataFrame(long, columns=["i", "n"])
    return duckdb.sql(
        """select a.i, b.i from table a join table b on a.i < b.i and abs(length(a.n) - length(b.n)) <= 0.2 * greatest(length(a.n), length(b.n)) + 1e-9
        where levenshtein(a.n, b.n) <= 0.2 * greatest(length(a.n), length(b.n)) + 1e-9""".replace("table", "long_lines"),
        connection=_connected(table),
    ).fetchall()


def _connected(table: pd.DataFrame) -> duckdb.DuckDBPyConnection:
    out = duckdb.connect()
    out.register("long_lines", table)
    return out


def brute_lines(rows: list[tuple]) -> dict:
    """Texts of (doc_id, text) without the lines that repeat or resemble, over any chain, an earlier one; it knows no keys."""
    where: dict[str, list] = {}
    for doc, text in rows:
        for i, x in enumerate((text or "").split("\n")):
            if x.split():
                where.setdefault(" ".join(x.lower().split()), []).append((doc, i))
    names = list(where)
    root = dict(zip(*local_roots(*np.array(brute_links(names), int).reshape(-1, 2).T), strict=True))
    groups: dict = {}
    for i, n in enumerate(names):
        groups.setdefault(root.get(i, i), []).extend(where[n])
    gone: dict = {}
    for g in groups.values():
        for doc, i in sorted(set(g))[1:]:
            gone.setdefault(doc, set()).add(i)
    return {doc: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc, ())) for doc, text in rows if text is not None}


@pytest.fixture(scope="module")
def paged():
    rng, common = np.random.default_rng(11), prose(60, 77)
    rows = []
    for d in range(60):
        own = [prose(int(rng.integers(1, 40)), 1000 + 31 * d + k) for k in range(5)]
        near = common.split()
        near[int(rng.integers(len(near)))] = "edited"
        rows.append((d, "\n".join([*own, common.upper() if d % 2 else common + " ", " ".join(near), "short line"])))
    return rows


def test_line_dedup_matches_brute_force(spark, paged, monkeypatch):
    want = brute_lines(paged)
    for group, bucket in ((lines.GROUP, lines.BUCKET), (8, 16)):  # the small limits send groups and buckets by chunks
        monkeypatch.setattr(lines, "GROUP", group)
        monkeypatch.setattr(lines, "BUCKET", bucket)
        got = {r["doc_id"]: r["text"] for r in rows_of(lines.dedup_lines(frame(spark, [(*r, "en", "s", 1) for r in paged])))}
        assert got == want
    assert sum("edited" in t for t in want.values()) < 60 and sum(prose(60, 77) in lines.normal(t) for t in want.values()) == 1


def test_line_dedup_of_odd_rows(docs, empty):
    out = lines.dedup_lines(docs, count=True)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == docs.columns and out.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in rows_of(out)}
    assert text[200] is None and text[201] == "" and text[101] == "" and text[None] == "no id here at all" and len(text[203].split()) == 30_000
    assert lines.dedup_lines(empty).count() == 0


def test_hot_line_buckets_are_dealt_whole(spark):
    """More lines with one key than a task takes, some twice, and keys of one line."""
    n = lines.BUCKET + 500
    df = spark.createDataFrame([(5, i) for i in range(n)] + [(5, i) for i in range(100)] + [(1000 + i, i) for i in range(50)] * 2, "key long, id long").withColumn("tell", F.lit(0).cast("long"))
    shared = lines.shared_keys(df, Scratch(spark, "t"))
    assert shared.count() == n
    found = components(lines.candidate_links(shared, Scratch(spark, "t")), Scratch(spark, "t"))
    assert found.count() == n - 1 and found.where("component <> 0").count() == 0


def test_lines_of_one_doc_id_with_different_texts(spark):
    """A line goes from the text that it repeats in, not from another text of that id; equal rows lose the same lines."""
    same, other, own = prose(12, 401), prose(15, 402), prose(14, 403)
    rows = [(3, same), (5, f"{same}\n{own}"), (5, f"{other}\n{own}"), (5, f"{other}\n{own}"), (None, same)]
    out = sorted((r["doc_id"] or 0, r["text"]) for r in rows_of(lines.dedup_lines(frame(spark, [(*r, "en", "s", 1) for r in rows]))))
    texts = [t for d, t in out if d == 5]
    assert out[0] == (0, same) and (3, same) in out and len(texts) == 3 and "\n".join(texts).count(own) in (1, 2)
    assert sum(t.startswith(other) for t in texts) == 2 and not any(same in t for t in texts)


def test_very_long_lines(spark):
    """Lines of more letters than a batch, one of them a single word, and near copies of them."""
    words = [f"w{i * 7919 % 104729:x}" for i in range(260_000)]
    near = list(words)
    near[1000] = near[200_000] = "changed"
    rows = [(1, " ".join(words)), (2, "x" * 200_000 + " a b c d e"), (3, " ".join(near)), (4, "y" + "x" * 200_000 + " a b c d e f"), (5, "short one here now")]
    assert len(rows[0][1]) > lines.BATCH
    got = {r["doc_id"]: len(r["text"]) for r in rows_of(lines.dedup_lines(frame(spark, [(*r, "en", "s", 1) for r in rows])))}
    assert got == {1: len(rows[0][1]), 2: len(rows[1][1]), 3: 0, 4: 0, 5: 18}


@given(st.lists(st.sampled_from("aa bb c dd eee".split()), min_size=1, max_size=9), st.lists(st.sampled_from("aa bb c dd eee f".split()), min_size=1, max_size=9), st.integers(0, 12))
@settings(max_examples=300, deadline=None)
def test_aligned_words_prove_no_more_than_the_distance(a, b, most):
    a, b = " ".join(a), " ".join(b)
    assert not lines.aligned(a, b, most) or lines.distance(a, b) <= most


def test_words_are_hashed_alike_wherever_they_lie():
    many = [prose(1 + k % 50, k) + " é字" for k in range(3000)]
    h, lengths, sizes = lines.words(many)
    named: dict = {}
    for w, x, n in zip(" ".join(many).split(), h.tolist(), lengths.tolist(), strict=True):
        assert named.setdefault(w, x) == x and n == len(w.encode())
    assert len(set(named.values())) == len(named) and sizes.tolist() == [len(x.split()) for x in many]


def test_line_dedup_finds_similar_lines(spark):
    """Recall against plain edit similarity: lines of 5 to 40 words with up to a sixth of their words replaced anywhere."""
    rng, rows = np.random.default_rng(23), []
    for d in range(400):
        own = prose(5 + d % 36, 50_000 + d).split()
        new = list(own)
        for i in rng.choice(len(own), max(1, len(own) // 6), replace=False):
            new[int(i)] = prose(1, int(rng.integers(1 << 30)))
        rows += [(d, " ".join(own)), (1000 + d, " ".join(new))]
    texts = dict(rows)
    wanted = {1000 + d for d in range(400) if lines.similar(texts[d], texts[1000 + d])}
    left = {r["doc_id"] for r in rows_of(lines.dedup_lines(frame(spark, [(*r, "en", "s", 1) for r in rows]))) if r["text"]}
    assert len(wanted) > 390 and {d for d in texts if d < 1000} <= left
    assert len(wanted - left) >= 0.97 * len(wanted)


def test_line_dedup_of_short_lines_and_text_without_blanks(spark):
    long = "今天天气很好我们一起去公园散步然后回家吃饭看电视"
    rows = [(1, f"Menu\nAll rights reserved.\n{long}\n\nab\nabout this site"), (2, f"menu\n{long}\nall  rights reserved.\n\nac\nabout that site"), (3, long.replace("公", "花") + "\nmenu\nabout thiz site")]
    got = {r["doc_id"]: r["text"] for r in rows_of(lines.dedup_lines(frame(spark, [(*r, "en", "s", 1) for r in rows])))}
    assert got == {1: rows[0][1], 2: "\nac", 3: ""}


def test_letter_pair_counts_spare_no_similar_pair():
    rng, texts = np.random.default_rng(3), []
    for k in range(300):
        x = list(prose(int(rng.integers(1, 20)), k))
        texts.append("".join(x))
        for _ in range(int(0.2 * len(x))):
            x[int(rng.integers(len(x)))] = str(rng.choice(list("abcé字 ")))
        texts.append("".join(x))
    left = np.arange(0, 600, 2)
    assert all(lines.similar(texts[i], texts[i + 1]) for i in left.tolist())
    assert list(lines.perhaps(lines.pair_counts(texts), np.array([len(x) for x in texts]), left, left + 1)) == list(range(300))


# ---------------------------------------------------------------- fingerprints


def test_sketches_estimate_and_merge():
    a, b = fingerprint.words(prose(3000, 1)), fingerprint.words(prose(2000, 1) + " " + prose(1500, 2))
    x, y = fingerprint.hashes(a), fingerprint.hashes(b)
    sx, sy = fingerprint.sketch(x), fingerprint.sketch(y)
    true = len(set(x) & set(y)) / len(set(x) | set(y))
    assert abs(fingerprint.resemblance(sx, sy) - true) < 0.12
    assert abs(fingerprint.containment(sx, sy) - len(set(x) & set(y)) / len(set(x))) < 0.2
    assert abs(fingerprint.distinct(sx) / len(set(x)) - 1) < 0.2
    assert (fingerprint.merge(fingerprint.sketch(x[:500]), fingerprint.sketch(x[500:])) == sx).all()
    assert (fingerprint.decode(fingerprint.encode(sx)) == sx).all()
    none = fingerprint.sketch(fingerprint.hashes([]))
    assert len(none) == 0 and fingerprint.resemblance(none, none) == 1.0 and fingerprint.resemblance(none, sx) == 0.0


def test_edited_fingerprints_match_brute_force(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in rows_of(fingerprint.edited_fingerprints(unique))}
    order = sorted(rows_of(unique.select("doc_id", "text")), key=lambda r: -r["doc_id"])
    assert len(got) == len(order)
    for own, following in zip(order, [*order[1:], order[0]], strict=True):
        text, k = own["text"] or "", len(own["text"] or "") // 3
        edited = text[: len(text) - k] + (following["text"] or "")[:k]
        r = got[own["doc_id"]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sk = lambda t: fingerprint.sketch(fingerprint.hashes(fingerprint.words(t)))
        assert r["edited_fingerprint"] == fingerprint.encode(sk(edited)) and r["near_edited"] == fingerprint.resemblance(sk(text), sk(edited))
        assert r["near_next"] == fingerprint.resemblance(sk(text), sk(following["text"]))
    assert fingerprint.edited_fingerprints(docs).count() == docs.count()
    assert fingerprint.edited_fingerprints(empty).count() == 0 and fingerprint.edited_fingerprints(docs.limit(1)).count() == 1
    assert fingerprint.fingerprints(docs).count() == docs.count()


def test_rows_of_one_id_follow_each_other_in_many_ranges(spark, monkeypatch):
    """Most rows have one id, or none: their next texts are those next by hash, and no range holds them all."""
    import xxhash

    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 10)
    rows = [(7, prose(5 + i % 9, i)) for i in range(300)] + [(None, prose(8, 5000 + i)) for i in range(60)] + [(i, prose(6, 9000 + i)) for i in range(100, 130)]
    share = {t: xxhash.xxh64_intdigest(t, seed=42) >> 11 for _, t in rows}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -share[r[1]]))
    want = set()
    for (doc, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        k = len(text) // 3
        want.add((doc, hashlib.sha256((text[: len(text) - k] + following[:k]).encode()).hexdigest()))
    out = fingerprint.edited_fingerprints(frame(spark, [(*r, "en", "s", 1) for r in rows]))
    assert {(r["doc_id"], r["edited_sha256"]) for r in rows_of(out)} == want and out.count() == len(rows)
    ids = spark.createDataFrame([(7, i / 300) for i in range(300)], "p long, u double")
    spans = rows_of(ids.groupBy(fingerprint._span([3, *[7] * 20, 9], F.col("p"), F.col("u")).alias("s")).count())
    assert len(spans) == 20 and max(r["count"] for r in spans) <= 16


# ---------------------------------------------------------------- packing


def test_merging_by_rank_is_what_the_tokenizer_does():
    assert packing.Merges(None).by_rank()
    fast, slow = packing.WordEncoder(None, True), packing.WordEncoder(None, False)
    texts = [prose(200, 3), "Don't  stop!! 12a3's  ÀÉ²½ª straße", "İx ŉ é Σς", "<|endoftext|>x", "a\0b", "a\x1cb", "", None, "日本語 text"]
    for t, a, b in zip(texts, fast.many(texts), slow.many(texts), strict=True):
        assert a.tolist() == b.tolist() == fast.whole(t or "").tolist()


def test_placing_minimises_the_sum_of_squares():
    p, rng = packing.Packer(16), np.random.default_rng(2)
    for i in range(300):
        n = int(rng.integers(1, 16))

        def after(h, n=n):
            c = p.counts.copy()
            c[h] -= h > 0
            if h + n < 16:
                c[h + n] += 1
            return int((c[1:16] ** 2).sum())

        options = {h: after(h) for h in range(17 - n) if h == 0 or p.counts[h]}
        at = p.place(n)
        assert options[at] == min(options.values())
        p.add(((i, n), 0, np.arange(n)))


def test_packing_round_trip(docs, empty):
    got = pd.DataFrame(rows_of(packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))))
    encode = packing.WordEncoder(None, True)
    for r in rows_of(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")):
        ids = np.append(encode.whole(r["text"] or ""), 1).astype("<u4")
        own = got[got.doc_id == r["doc_id"]].sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert (own.start == own.length.cumsum() - own.length).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((g.offset == g.length.cumsum() - g.length).all() for _, g in by)
    full = by.length.sum()
    assert all(n <= 2048 and n & (n - 1) == 0 for n in full)
    assert packing.pack(empty).count() == 0 and packing.pack(docs).where("doc_id is null").count() >= 1


# ---------------------------------------------------------------- licences


def test_licenses_and_inheritance(spark):
    rows = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/x.txt", prose(50, 1)), (3, "a/b/y.txt", prose(9, 2) + "\nReleased under the MIT License.\n" + prose(9, 3)), (4, "c/z.txt", prose(20, 4)), (5, None, None), (6, "a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (7, "top.txt", "You must renew your license yearly"), (2, "a/b/x.txt", prose(50, 1))]
    got = rows_of(licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "key long, path string, text string, own int")))
    by = {r["key"]: r for r in got}
    assert len(got) == 8 and by[1]["license"] == "Apache-2.0" and by[3]["license"] == "MIT" and by[3]["from_path"] is None
    assert by[2]["own_license"] is None and by[2]["license"] == "GPL-3.0" and by[2]["from_path"] == "a/b"
    assert by[4]["license"] is None and by[5]["license"] is None and by[7]["license"] is None
    assert licenses.scan(spark.createDataFrame([], "key long, path string, text string")).count() == 0


def brute_license(files: list[tuple]) -> dict:
    """Licence and directory of each (key, path, text), by cosines in full and by walking up the path."""
    n, seen = len(files), {}
    for t in licenses.VOCABULARY:
        seen[t] = sum(t in licenses.terms(text or "") for _, _, text in files)
    weight = lambda t: np.log((1 + n) / (1 + seen[t])) + 1 if t in seen else max(np.log((1 + n) / (1 + x)) + 1 for x in seen.values())
    vector = lambda found: {t: (1 + np.log(found.count(t))) * weight(t) for t in set(found)}
    size = lambda v: np.sqrt(sum(x * x for x in v.values()))
    pieces = [(k, vector(list(c.elements()))) for k, c in licenses.TEMPLATES]
    own, speaks = {}, {}
    for key, path, text in files:
        best = (0.0, "")
        for line in (text or "").split("\n"):  # the files of this test have licences of one line
            v = vector(licenses.terms(line))
            for k, c in pieces if v else ():
                best = max(best, (round(float(sum(x * v.get(t, 0) for t, x in c.items()) / size(c) / size(v)), 12), k))
        own[key] = best[1] if best[0] >= licenses.LEAST else None
        base = path.rpartition("/")[2].lower().partition(".")[0]
        if own[key] and base in licenses.NAMES:
            speaks.setdefault(path.rpartition("/")[0], {})[path] = own[key]
    out = {}
    for key, path, _ in files:
        at, found = path.rpartition("/")[0], (own[key], None)
        while found[0] is None:
            if at in speaks:
                found = (speaks[at][min(speaks[at])], at)
            if not at:
                break
            at = at.rpartition("/")[0]
        out[key] = found
    return out


def test_licenses_match_brute_force(spark):
    rng, files = np.random.default_rng(12), []
    notices = [" ".join(t.split("\n\n")[0].split()) for t in licenses.TEXTS.values()] + [f"Copyright 2020. {t}." for t in licenses.TITLES.values()]
    for i in range(250):
        folder = "/".join(str(x) for x in rng.integers(0, 3, int(rng.integers(0, 4))))
        named = rng.random() < 0.3
        lines = [prose(int(rng.integers(3, 30)), 900 + i + k) for k in range(3)]
        if named or rng.random() < 0.1:
            lines.insert(1, str(rng.choice(notices)))
            lines[0] = lines[2] = lines[3] = prose(40, i)  # nothing that is mostly a licence
        files.append((i, f"{folder}/{'LICENSE.' if named else 'f'}{i}".lstrip("/"), "\n".join(lines)))
    want = brute_license(files)
    got = {r["key"]: (r["license"], r["from_path"]) for r in rows_of(licenses.scan(spark.createDataFrame(files, "key long, path string, text string")))}
    assert got == want
    assert len({x for x, _ in want.values()}) > 8 and sum(d is not None for _, d in want.values()) > 50


def test_whole_license_texts_and_odd_files(spark):
    rows = [(i, f"p{i}/{'LICENSE' if i % 2 else 'a.txt'}", f"{licenses.TITLES[k]}\n\n{text}") for i, (k, text) in enumerate(licenses.TEXTS.items())]
    rows += [(100, "p0/b.txt", prose(30, 1)), (101, "q/x.txt", "word " * 50_000), (102, "q/y.txt", ""), (102, "q/y.txt", None), (None, "p1/z.txt", prose(9, 2)), (103, None, licenses.TEXTS["MIT"])]
    got = rows_of(licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "key long, path string, text string, own int")))
    by = {r["key"]: r for r in got}
    assert [by[i]["own_license"] for i in range(len(licenses.TEXTS))] == list(licenses.TEXTS) and len(got) == len(rows)
    assert by[100]["license"] == "MIT" and by[100]["from_path"] == "p0"  # mostly a licence, whatever its name
    assert by[None]["license"] == "ISC" and by[101]["license"] is None and by[102]["license"] is None and by[103]["own_license"] == "MIT"


def test_some_documents_inherit(spark):
    docs = spark.createDataFrame([(i, licenses.TEXTS["MPL-2.0"] if i == 8 else licenses.TEXTS["MIT"] if i == 32 else prose(20, i), "en", "s") for i in [*range(1, 300), 1500]] + [(None, "x", None, None)], "doc_id long, text string, lang string, source string")
    path = licenses.tree_path(F.col("doc_id"), F.col("source"), F.col("lang"))
    got = {r["key"]: r for r in rows_of(licenses.scan(docs.select(F.col("doc_id").alias("key"), path.alias("path"), "text")))}
    assert got[5]["license"] == "MPL-2.0" and got[5]["from_path"] == "s/en/0/0" and got[200]["license"] == "MIT" and got[200]["from_path"] == "s/en/0"
    assert got[1500]["license"] is None and got[None]["license"] is None


# ---------------------------------------------------------------- SimHash


def brute_print(text: str | None) -> int:
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_fingerprints_match_brute_force():
    for t in [None, "", "A b", "Ä É a B c d e", prose(500, 9), "x y z\x0bw q"]:
        assert simhash.fingerprint(t) == brute_print(t)


@given(st.lists(st.integers(0, 63), max_size=4), st.integers(0, 2**64 - 1))
@settings(max_examples=300, deadline=None)
def test_some_join_key_and_chain_finds_every_pair(bits, x):
    y = x
    for b in bits:
        y ^= 1 << b
    found = []
    for start, mask in simhash.KEYS:
        if x & mask == y & mask:
            found += list(next(simhash.near(np.array([x], np.uint64), np.array([y], np.uint64), start)))
    assert found


def test_simhash_components_match_brute_force(spark, docs, empty, monkeypatch):
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    for x in list(prints):
        for _ in range(6):
            for b in rng.integers(0, 64, int(rng.integers(1, 6))):
                x ^= 1 << int(b)
            prints.append(x)
    signed = [(x - (1 << 64) if x >= 1 << 63 else x, i) for i, x in enumerate(dict.fromkeys(prints))]
    fp = np.array([x for x, _ in signed], np.int64).view(np.uint64)
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= simhash.T)
    want = dict(zip(*local_roots(a, b), strict=True))
    table = spark.createDataFrame(signed, "fp long, rep long")
    found = components(simhash.links(table, Scratch(spark, "t")), Scratch(spark, "t"))
    assert {r["node"]: r["component"] for r in rows_of(found)} == want
    out = {r["doc_id"]: r for r in rows_of(simhash.simhash_components(docs))}
    assert out[101]["component_id"] == out[102]["component_id"] == 100 and out[200]["component_id"] == out[202]["component_id"] == 200
    assert out[None]["component_id"] is None and out[200]["fingerprint"] == "0" * 16
    assert simhash.simhash_components(docs).count() == docs.count() and simhash.simhash_components(empty).count() == 0
    kept = simhash.keep_one(docs)
    ids = [r["doc_id"] for r in rows_of(kept)]
    assert kept.columns == docs.columns and {100, 200, 203, 204, None} <= set(ids) and not {101, 102, 201, 202} & set(ids)


def test_hot_simhash_buckets_are_dealt_whole(spark):
    """More rows in one bucket than a task takes: a cube in bits 40 to 53."""
    low = [i << 40 for i in range(simhash.BUCKET + 3000)]
    table = spark.createDataFrame([(x, i) for i, x in enumerate(low)], "fp long, rep long")
    found = components(simhash.links(table, Scratch(spark, "t")), Scratch(spark, "t"))
    assert found.count() == len(low) - 1 and found.where("component <> 0").count() == 0


# ---------------------------------------------------------------- embeddings


def brute_vectors(x) -> tuple[np.ndarray, dict]:
    """Which vectors link, and the least member of each one's group."""
    u = embedding.unit(list(x))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    return near, dict(zip(*local_roots(*np.nonzero(near)), strict=True))


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([rng.normal(size=(400, 16)), np.repeat(centres, 20, axis=0) + rng.normal(size=(600, 16)) * 0.12]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 50, axis=0)])
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0] * 15 + [None]), (5004, [float("nan")] * 16), (5005, [float("inf")] + [1.0] * 15), (None, x[0].tolist()), (5006, [1.0, 2.0]), (5007, [2.0, 4.0])]
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v, None) for i, v in odd], "vec_id long, embedding array<float>, n int")
    near, want = brute_vectors(x)
    for kwargs in ({}, {"split": 200, "cell": 80}, {"split": 100, "cell": 40, "fanout": 4}):  # whole, one level, several levels
        got = {r["vec_id"]: r for r in rows_of(embedding.embedding_components(table, **kwargs))}
        found = sum(got[i]["n_links"] for i in range(len(x)))
        assert 0.9 * near.sum() <= found <= near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
        assert kwargs or found == near.sum()
        assert np.mean([got[i]["component_id"] == want.get(i, i) for i in range(len(x))]) >= 0.9
        for i in range(5000, 5006):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
        assert got[5007]["component_id"] == 5006 and not got[5007]["kept"] and got[None]["n_links"] == 0 and got[None]["kept"]
    assert embedding.embedding_components(table.where("false")).count() == 0


@pytest.mark.parametrize("shared", [0.0, 0.5, 0.8])
def test_cells_hold_links_whatever_direction_vectors_share(spark, shared):
    """Vectors of a mean cosine of shared, a third with a near copy at a cosine of 0.95 to 1."""
    rng, d, n = np.random.default_rng(3), 64, 3000
    x = np.sqrt(1 - shared) * embedding.unit(list(rng.normal(size=(n, d))))
    x[:, 0] += np.sqrt(shared)
    x = embedding.unit(list(x))
    copies = embedding.unit(list(x[::3] + rng.normal(size=(n // 3, d)) * rng.uniform(0, 0.33, (n // 3, 1)) / np.sqrt(d)))
    x = np.concatenate([x, copies])
    near, want = brute_vectors(x)
    assert near.sum() > 1500
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scratch = Scratch(spark, "t")
    distinct = table.select(F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("n"), F.col("embedding").alias("v"))
    placed = embedding.in_cells(distinct, scratch, 0.95, 500, 200, 256)
    sizes = [r["count"] for r in rows_of(placed.groupBy("cell").count())]
    # two levels of splits here; each copies a vector to PROBES parts at most
    assert len(sizes) > 5 and sum(sizes) <= embedding.PROBES**2 * len(x) and max(sizes) <= 500
    got = {r["vec_id"]: r for r in rows_of(embedding.embedding_components(table, split=500, cell=200))}
    assert 0.9 * near.sum() <= sum(r["n_links"] for r in got.values()) <= near.sum()
    assert np.mean([got[i]["component_id"] == want.get(i, i) for i in range(len(x))]) >= 0.9


def test_cells_grow_with_the_rows(spark):
    """Five times the rows give no more than five times (and a quarter) the rows that are multiplied."""
    rng, dealt = np.random.default_rng(4), []
    for n in (1500, 7500):
        df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 32)))], "node long, n long, v array<double>")
        placed = embedding.in_cells(df, Scratch(spark, "t"), 0.95, 400, 150, 256)
        sizes = np.array([r["count"] for r in rows_of(placed.groupBy("cell").count())])
        dealt.append((sizes.sum(), (sizes**2).sum()))
    assert dealt[1][0] <= 6.25 * dealt[0][0] and dealt[1][1] <= 8 * dealt[0][1]


def test_rows_of_one_vec_id_are_pooled(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows_of(embedding.embedding_components(table([(3, x), (5, x), (5, y), (7, y)]))))
    assert out == [(3, 1, 3), (5, 1, 3), (5, 1, 3), (7, 1, 3)]
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows_of(embedding.embedding_components(table([(5, x), (7, x), (5, y), (8, [0.0, 1.0, 0.1])]))))
    assert out == [(5, 1, 5), (5, 1, 5), (7, 1, 5), (8, 1, 5)]


# ---------------------------------------------------------------- language


def test_longest_matches_against_brute_force():
    text = "abracadabra banana cabana"
    a = language.SuffixAutomaton(text)

    def brute(s):
        n = at = 0
        while at < len(s):
            end = at
            while end < len(s) and s[at : end + 1] in text:
                end += 1
            n, at = n + 1, max(end, at + 1)
        return n

    rng = np.random.default_rng(0)
    for _ in range(200):
        s = "".join(rng.choice(list("abcdnrx "), int(rng.integers(0, 20))))
        assert a.phrases(s) == brute(s)


def test_whole_texts_match_brute_force(spark):
    """Language and score of texts of several lines, by greedy search for substrings of the samples."""
    samples = {"aa": "ka to mira kato mira toka", "bb": "schung er ein erung sch ein", "cc": "x"}

    def brute(text):
        own = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
        if not own:
            return "und", 0.0
        rates = []
        for k in sorted(samples):
            n = at = 0
            while at < len(own):
                end = at + 1
                while end <= len(own) and own[at:end] in samples[k]:
                    end += 1
                n, at = n + 1, max(end - 1, at + 1)
            rates.append(n * np.log2(len(samples[k]) + 1) / len(own))
        best = int(np.argmin(rates))
        return sorted(samples)[best], 1 / sum(np.exp(-language.SHARPNESS * (r - rates[best])) for r in rates)

    rng = np.random.default_rng(6)
    rows = [(i, "".join(rng.choice(["ka", "to", "mi", " ", "sch", "er", "x", "\n", "3, "], int(rng.integers(0, 60)))), None, None, None) for i in range(300)]
    got = {r["doc_id"]: r for r in rows_of(language.identify(frame(spark, rows), samples))}
    for i, text, *_ in rows:
        lang, score = brute(text)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-9


def test_texts_side_by_side_are_parsed_as_one_by_one(monkeypatch):
    """Any number of texts of any lengths, with letters that no sample has, and automata too large for a table."""
    rng = np.random.default_rng(8)
    samples = {"aa": "ka to mira kato mira toka", "bb": "schung er ein \U00010400\u4e00\u4e01 sch ein", "cc": "x"}
    pieces = ["ka", "to", "mi", " ", "sch", "er", "x", "\u4e00", "\U00010400", "\ud7a3", "\u00e9", "3 "]
    texts = [None, "", "7!"] + ["".join(rng.choice(pieces, int(n))) for n in np.r_[rng.integers(0, 40, 200), 900, 901, 2000]]
    whole = language.Parser(samples)
    alone = {k: language.SuffixAutomaton(samples[k]) for k in samples}
    for n in (1, 5, 40, len(texts)):
        some = texts[:n] if n < 40 else texts[-n:]
        own = sorted((r for t in some if (r := language.running(t))), key=len, reverse=True)
        if own:
            assert whole._counts(own).tolist() == [[alone[k].phrases(t) for t in own] for k in sorted(samples)]
    found = whole.all(texts)
    assert whole.table is not None and found == [whole(t) for t in texts] and found[:3] == [("und", 0.0)] * 3
    monkeypatch.setattr(language, "STEPS", 10)
    large = language.Parser(samples)
    assert large.table is None and large.all(texts) == found and language.Parser({}).all(["ka"]) == [("und", 0.0)]


def test_samples_are_bounded_running_text(spark):
    rows = [(i, f"start {prose(3000, i)} END", "aa" if i % 2 else "bb", "s", 1) for i in range(60)]
    found = language.fit(frame(spark, rows), passage=300, letters_most=3000)
    assert set(found) == {"aa", "bb"} and all(2000 < len(x) <= 3000 + 10 for x in found.values())
    whole = " ".join(language.running(t) for _, t, *_ in rows)
    assert all(" ".join(x.split()[:20]) in whole for x in found.values())


def test_language_of_held_out_and_odd_rows(spark, empty):
    parts = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "er", "ein"]}
    rows = []
    for i in range(200):
        k = "aa" if i % 2 else "bb"
        rng = np.random.default_rng(i)
        rows.append((i, " ".join("".join(rng.choice(parts[k], 3)) for _ in range(15)), k, "s", 1))
    rows += [(900, None, "aa", "s", 1), (901, "", None, "s", 1), (902, "123 !!", "aa", "s", 1), (None, "katomi", "bb", "s", 1), (903, "katomi tora " * 20_000, None, None, None)]
    docs = frame(spark, rows)
    learned = language.fit(docs)
    got = {r["doc_id"]: r for r in rows_of(language.identify(docs, learned))}
    assert all(got[i]["lang_pred"] == ("aa" if i % 2 else "bb") for i in range(200)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    changed = docs.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'zz' else lang end as lang", "text")
    assert language.fit(changed) == learned
    assert language.fit(empty) == {} and language.identify(docs, {}).where("lang_pred <> 'und'").count() == 0 and language.identify(empty, learned).count() == 0


def test_packed_keys_are_the_exploded_ones(spark, monkeypatch):
    """Keys that move packed give the buckets of the plain rows; a part too large for memory keeps enough of a hot key to know it."""
    rng = np.random.default_rng(3)
    base = [rng.integers(-9, 9, 3 + len(lines.PARTS)).tolist() for _ in range(300)]
    base[0][1] = base[1][1] = 1 << 15
    columns = ["h1", "tell", "sim", *lines.PARTS]
    df = spark.createDataFrame([(i, 1 << 15, *row[2:]) for i, row in enumerate(base)] * 2, ", ".join(f"{c} long" for c in columns))
    second = [F.when(F.col(a) != F.col(b), F.col(b)) for a, b in ((lines.PARTS[0], lines.PARTS[2]), (lines.PARTS[1], lines.PARTS[3]))]
    keys = F.array(*lines.block_keys(F.col("sim")), *lines.PARTS[:2], *second, *lines.PARTS[4:])
    rows = df.select(F.explode(keys).alias("key"), F.col("h1").alias("id"), "tell").where("key is not null")
    scratch = lines.Scratch(spark, "packed")
    found = [sorted(map(tuple, lines.shared_keys(rows, scratch, x).collect())) for x in (None, df)]
    assert found[0] == found[1] and len(found[0]) > 300
    monkeypatch.setattr(lines, "BUCKET", 5)
    monkeypatch.setattr(lines, "PACKED", 20)
    batch = df.toArrow().combine_chunks().to_batches()
    packs = sorted((r for b in lines.packed(iter(batch), 4) for r in b.to_pylist()), key=lambda r: r["part"])
    whole = list(lines.unpacked(iter([pa.RecordBatch.from_pylist(packs, schema=pa.schema([("part", pa.int32()), ("rows", pa.binary())]))])))
    n = {}
    for b in whole:
        for r in b.to_pylist():
            n.setdefault(r["key"], set()).add(r["id"])
    true = {r["key"]: set(r["ids"]) for r in rows.groupBy("key").agg(F.collect_set("id").alias("ids")).collect()}
    assert n.keys() == true.keys() and all(n[k] <= true[k] and len(n[k]) >= min(6, len(true[k])) for k in true)


def test_distances_side_by_side():
    """Pairs of any lengths and letters, measured at once, against the distance of each."""
    rng, pairs = np.random.default_rng(23), []
    for n in range(600):
        alphabet = ("ab", "abcdefgh ", "abé日本\U0001f600")[n % 3]
        draw = lambda size: [alphabet[i] for i in rng.integers(0, len(alphabet), size)]  # noqa: E731, B023
        a = draw(int(rng.choice([0, 1, 9, 40, 200, 1200 if n % 50 == 0 else 300])))
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(int(rng.integers(0, len(a) // 8 + 2))):
            b.insert(int(rng.integers(0, len(b) + 1)), draw(1)[0])
        a, b = "".join(a), "".join(b)
        pairs.append((a, b, float(rng.choice([0, 2, 0.2 * len(a), 0.2 * len(a) + 200]))))
    want = [lines.distance(a, b) <= most for a, b, most in pairs]
    assert lines.within(pairs).tolist() == want and 100 < sum(want) < 550
    assert lines.within([]).tolist() == [] and lines.within(pairs[:3]).tolist() == want[:3]


def test_large_groups_of_near_lines_meet_in_few_distances(monkeypatch):
    """Lines of which each third word differs by a letter, which only distances tell: soon no pair is left to be measured."""
    measured, own = [], lines.within
    monkeypatch.setattr(lines, "within", lambda pairs: measured.append(len(pairs)) or own(pairs))
    base = prose(40, 5).split()
    texts = [" ".join(w if i % 3 else w[: n % len(w)] + chr(97 + n % 26) + w[n % len(w) + 1 :] for i, w in enumerate(base)) for n in range(400)]
    frame = pd.DataFrame({"deal": 0, "a": 0, "b": 0, "part": 0, "side": -1, "id": range(400), "tell": 1 << 15, "text": texts})
    out = pd.concat(lines._verify(iter([frame])))
    assert all(lines.similar(texts[0], y) for y in texts)
    a, b = np.zeros(399, int), np.arange(1, 400)
    assert sum(measured) < 2000 and dict(zip(*local_roots(out.u.to_numpy(), out.v.to_numpy()), strict=True)) == dict(zip(*local_roots(a, b), strict=True))


def test_unlike_lines_of_one_bucket_wait_for_each_other(monkeypatch):
    """Of lines that only distances tell apart, thousands are measured at a time, and hardly any has its words aligned."""
    measured, aligned, own, words = [], [], lines.within, lines.aligned
    monkeypatch.setattr(lines, "within", lambda pairs: measured.append(len(pairs)) or own(pairs))
    monkeypatch.setattr(lines, "aligned", lambda a, b, most: aligned.append(a) or words(a, b, most))
    rng, parts = np.random.default_rng(9), ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    texts = [" ".join("".join(rng.choice(parts, int(rng.integers(1, 4)))) for _ in range(70))[:300] for _ in range(150)]
    near = texts[7].replace(" ", "", 9)
    frame = pd.DataFrame({"deal": 0, "a": 0, "b": 0, "part": 0, "side": -1, "id": range(151), "tell": 1 << 15, "text": [*texts, near]})
    out = pd.concat(lines._verify(iter([frame])))
    assert out.values.tolist() == [[150, 7]]
    assert sum(measured) > 8000 and len(measured) < 6 and len(aligned) < 500


def test_long_distances_look_back_seldom(monkeypatch):
    """How far a table's nearest cells are is known for as many columns as they lack to the most edits."""
    looks, own = [], lines.least_near
    monkeypatch.setattr(lines, "least_near", lambda *x: looks.append(x[2]) or own(*x))
    rng = np.random.default_rng(4)
    a = "".join(rng.choice(list("abcdefgh "), 8000))
    b = "".join(x if rng.random() > 0.1 else "z" for x in a)
    other = "".join(rng.choice(list("abcdefgh "), 8000))
    assert lines.distance(a, b, 1600) == sum(x != y for x, y in zip(a, b, strict=True)) and len(looks) < 15
    looks.clear()
    assert lines.distance(a, other, 1600) > 1600 and len(looks) < 15 and looks[-1] < 5000


def test_keys_of_lines_move_in_blocks():
    """Rows of lines have one value of keys a batch, which are those of the lines' tokens."""
    texts = [prose(5 + k % 30, k) for k in range(50)] + ["short", prose(9, 3)]
    batch = pa.record_batch([pa.array(range(52)), pa.array([7] * 52), pa.array(texts)], names=["doc_id", "th", "text"])
    out = list(lines._lines(iter([batch])))
    assert [b.num_rows for b in out] == [52] and out[0].schema == lines.LINES
    rows = out[0].to_pylist()
    assert [r["keyed"] for r in rows] == [51] + [None] * 51 and [r["keys"] is None for r in rows] == [False] + [True] * 51
    found = next(lines.keyed_lines(iter([out[0].select(["keys"]).slice(0, 1)])))
    toks = [t for t in texts if t != "short"]
    want = lines.all_keys(toks, np.array([len(t) for t in toks]), np.ones(51, bool))
    assert found.schema.names == lines.KEYED and found.column(0).to_pylist() == [r["h1"] for r in rows if texts[r["doc_id"]] != "short"]
    assert (np.stack([c.to_numpy() for c in found.columns[1:]], axis=1) == want).all()
    assert list(lines._lines(iter([batch.slice(50, 1)])))[0].column(6).null_count == 1
