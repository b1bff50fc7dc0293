"""Operators of the engine on small frames with known answers."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.functions import exprs as X
from riskweave.functions import ranks
from riskweave.operators import dashboard, eda, encoders, linkage, metrics, payments, providers, sampling, stats
from riskweave.plans import boosting, experiments, isolation_forest, models
from riskweave.sources import artifacts, io
from riskweave.streaming import incremental


def rows(df):
    return [r.asDict() for r in df.collect()]


def value(spark, column, *data, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], schema).select(column).collect()]


# ---------------------------------------------------------------- expressions


def test_names_ids_and_flags(spark):
    assert value(spark, X.normalize_name(F.col("c")), " o'Brien-Lee  Jr ", None, "Ñu ñ", "") == ["OBRIENLEE JR", "", "U", ""]
    assert value(spark, X.list_id(F.col("c")), " 12 ", "0000000000", "", None) == ["12", "", "", ""]
    assert value(spark, X.yes_flag(F.col("c")), "Yes", "No", None) == [1, 0, 0]
    assert value(spark, X.third_party_flag(F.col("c")), "No Third Party Payment", "Entity", None) == [0, 1, 1]
    assert value(spark, X.remap(F.col("c"), {"Food": "food"}), "Food", "Golf", None) == ["food", "other", "other"]
    assert [str(x) for x in value(spark, X.parse_date(F.col("c")), "02/29/2024", "13/01/2024", "x", None)] == ["2024-02-29", "None", "None", "None"]
    assert value(spark, X.log_amount(F.col("c")), -5.0, 0.0, None, schema="c double") == [0.0, 0.0, None]


@given(st.lists(st.text(alphabet="ABC", max_size=6), min_size=2, max_size=2))
@settings(max_examples=15, deadline=None)
def test_dice_matches_sets(spark, two):
    a, b = ({s[i : i + 2] for i in range(len(s) - 1)} or ({s} if s else set()) for s in two)
    want = 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0
    got = spark.createDataFrame([tuple(two)], "a string, b string").select(X.dice(X.bigrams(F.col("a")), X.bigrams(F.col("b")))).first()[0]
    assert got == pytest.approx(want)


# ---------------------------------------------------------------- providers

PAYMENT = "npi long, specialty string, manufacturer string, nature string, amount double, related int, third_party int, is_excluded int"


def payment(npi, specialty="Psychiatry", manufacturer="Big Pharma", nature="food_beverage", amount=10.0, related=1, third_party=0, excluded=0):
    return (npi, specialty, manufacturer, nature, amount, related, third_party, excluded)


def test_one_row_per_provider(spark):
    df = spark.createDataFrame([payment(1, excluded=1)] * 3 + [payment(2)] * 5 + [payment(3)], PAYMENT)
    got = {r["npi"]: r for r in rows(providers.rollup(df))}
    assert {k: r["is_excluded"] for k, r in got.items()} == {1: 1, 2: 0, 3: 0} and got[2]["total_payment_count"] == 5
    providers.check_constant_label(df)
    with pytest.raises(ValueError, match="is_excluded"):
        providers.check_constant_label(df.union(spark.createDataFrame([payment(1)], PAYMENT)))


def test_mode_and_concentration(spark):
    df = spark.createDataFrame([payment(1)] * 3 + [payment(1, "Neurology"), payment(2, "B"), payment(2, "A")], PAYMENT)
    got = {r["npi"]: r for r in rows(providers.mode(df, "specialty", "top"))}
    assert (got[1]["top"], got[1]["n_specialty"], got[2]["top"]) == ("Psychiatry", 2, "A")
    df = spark.createDataFrame([payment(1, manufacturer="A", amount=60.0, nature="food"), payment(1, manufacturer="A", amount=20.0, related=0), payment(1, manufacturer="B", amount=20.0, third_party=1), payment(1, manufacturer="C", amount=0.0)], PAYMENT)
    pairs = providers.manufacturer_pairs(df)
    r = rows(providers.concentration(pairs))[0]
    assert r["n_distinct_manufacturers"] == 3 and r["top_manufacturer_amount_share"] == pytest.approx(0.8)
    assert pairs.where("manufacturer = 'A'").first()["payment_count"] == 2
    mix = rows(providers.nature_mix(df, ["food", "food_beverage"]))[0]
    assert mix["share_nature_food"] == 0.25 and mix["share_nature_food"] + mix["share_nature_food_beverage"] == 1.0
    r = rows(providers.rollup(df))[0]
    assert (r["share_related_product"], r["share_third_party_payment"]) == (0.75, 0.25)
    none = providers.concentration(providers.manufacturer_pairs(spark.createDataFrame([payment(9, amount=0.0)], PAYMENT)))
    assert none.first()["top_manufacturer_amount_share"] is None


def test_payment_frequency_drops_nulls_and_counts_zero(spark):
    df = spark.createDataFrame([(0,), (0,), (None,), (5,)], "npi long")
    assert {r["npi"]: r["payment_frequency"] for r in rows(payments.payment_frequency(df))} == {0: 2, 5: 1}


# ---------------------------------------------------------------- linkage


def test_exact_and_fuzzy_links(spark):
    p = spark.createDataFrame([(1, 10), (2, None), (3, 0), (4, 11)], "id int, npi long")
    listed = spark.createDataFrame([(10,), (10,), (0,), (None,)], "k long")
    assert {r["id"]: r["is_excluded"] for r in rows(linkage.exact_flag(p, listed, "npi", "k"))} == {1: 1, 2: 0, 3: 0, 4: 0}
    people = spark.createDataFrame([("TX", "SMITH", "JOHN"), ("TX", "SMYTHE", "JON"), ("CA", "SMITH", "JOHN"), (None, "SMITH", "JOHN"), ("TX", "SMITH", "ZED")], "state string, last string, first string")
    listed = spark.createDataFrame([("TX", "SMITH", "JOHN"), ("TX", "", "JOHN"), (None, "SMITH", "JOHN")], "state string, last string, first string")
    got = {(r["state"], r["last"], r["first"]): (r["is_match"], r["confidence"]) for r in rows(linkage.fuzzy_matches(people, listed))}
    assert got["TX", "SMITH", "JOHN"] == (1, 1.0) and got["CA", "SMITH", "JOHN"] == (0, 0.0) and got["TX", "SMITH", "ZED"] == (0, 0.0)
    assert got["TX", "SMYTHE", "JON"][0] == 0 and got[None, "SMITH", "JOHN"] == (0, 0.0)


def test_alignment_and_lookups(spark):
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(3,), (2,), (1,)], "id long")
    assert linkage.misaligned(a, b, "id").count() == 0 and linkage.misaligned(a, b.where("id > 1").union(b.where("id = 2")), "id").count() == 2
    lookup = spark.createDataFrame([(10, 555), (11, None), (12, 777), (13, 999)], "id long, npi long")
    want = spark.createDataFrame([(12,), (10,), (11,)], "id long")
    assert {r["id"]: r["npi"] for r in rows(linkage.attach_ids(want, lookup, "id", "npi"))} == {12: 777, 10: 555, 11: None}
    with pytest.raises(ValueError, match="no row"):
        linkage.attach_ids(spark.createDataFrame([(404,)], "id long"), lookup, "id", "npi")
    with pytest.raises(ValueError, match="unique"):
        linkage.attach_ids(want, lookup.union(lookup), "id", "npi")


# ---------------------------------------------------------------- samples


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(1020).select(F.col("id").alias("npi"), (F.col("id") < 20).cast("int").alias("y")).cache()


def test_exact_sample_is_reproducible(people):
    got = sampling.exact_negatives(people, "npi", "y", 0.1)
    assert got.where("y = 1").count() == 20 and got.where("y = 0").count() == 100
    assert {r[0] for r in sampling.exact_negatives(people.repartition(7), "npi", "y", 0.1).select("npi").collect()} == {r[0] for r in got.select("npi").collect()}


def test_group_split_is_disjoint_and_stratified(spark, people):
    src = people.withColumn("r", F.explode(F.sequence(F.lit(1), (F.col("npi") % 8 + 1).cast("int"))))
    split = sampling.group_split(src, "npi", "y")
    test, train = split.where("is_test = 1"), split.where("is_test = 0")
    assert sampling.overlap(test, train, "npi").count() == 0 and test.select("npi").distinct().count() == 204
    assert test.where("y = 1").select("npi").distinct().count() == 4
    counts = rows(sampling.folds(people, "npi", "y").groupBy("fold", "y").count())
    assert {(r["y"], r["count"]) for r in counts} == {(1, 4), (0, 200)}
    ids = rows(sampling.with_groups(spark.createDataFrame([(0, 111), (1, None), (2, 111), (3, None), (4, 222)], "rec long, npi long"), "npi", "rec"))
    found = [r["group_id"] for r in sorted(ids, key=lambda r: r["rec"])]
    assert found[0] == found[2] == 111 and found[1] < 0 and found[3] < 0 and found[1] != found[3]


def test_plain_sample_keeps_positives(people):
    got = sampling.sample(people, "npi", 0.05, keep="y")
    assert got.where("y = 1").count() == 20 and 15 <= got.where("y = 0").count() <= 90


# ---------------------------------------------------------------- encoders


def test_out_of_fold_ignores_own_label(spark):
    data = [("A", int(i < 10), i % 5) for i in range(100)] + [("B", int(i < 5), i % 5) for i in range(99)] + [("SOLO", 1, 0)]
    df = spark.createDataFrame(data, "c string, y int, fold int")
    got = {(r["c"], r["fold"]): r["e"] for r in rows(encoders.out_of_fold(df, "c", "y", "fold", "e").select("c", "fold", "e").distinct())}
    others = [y for _, y, f in data if f != 0]
    assert got["SOLO", 0] == pytest.approx(np.mean(others))
    own = [y for c, y, f in data if c == "A" and f != 2]
    g = np.mean([y for _, y, f in data if f != 2])
    assert got["A", 2] == pytest.approx((sum(own) + 50 * g) / (len(own) + 50))


def test_group_folds_hide_sibling_rows(spark):
    data = [("RareCo", 1, 1, i % 5, 0) for i in range(6)] + [("BigCo", int(i < 15), 100 + i, i % 5, i % 5) for i in range(300)]
    df = spark.createDataFrame(data, "c string, y int, npi int, row_fold int, group_fold int")
    mean = 21 / 306
    by_row = encoders.out_of_fold(df, "c", "y", "row_fold", "e").where("c = 'RareCo'").agg(F.max("e")).first()[0]
    by_group = encoders.out_of_fold(df, "c", "y", "group_fold", "e").where("c = 'RareCo'").agg(F.max("e")).first()[0]
    assert by_group < 1.5 * mean < by_row


def test_preprocessor_paths_agree(spark):
    rng = np.random.default_rng(0)
    data = [(i, None if i < 3 else float(rng.integers(1, 9)), [None, "Psychiatry", "Family Medicine"][i % 3], "cash" if i % 2 else "rare", int(i % 7 == 0), i % 5) for i in range(300)]
    df = spark.createDataFrame(data, "id int, freq double, specialty string, form string, y int, fold int")
    p = encoders.Preprocessor(["freq"], ["specialty"], ["form"], "y", rare=160)
    train = p.fit_transform(df, "fold")
    again = p.transform(df)
    assert set(train.columns) == set(again.columns) and train.count() == again.count() == 300
    assert p.kept["form"] == [] and again.where("form_Other <> 1").count() == 0 and again.where("freq_missing = 1").count() == 3
    differ = train.select("id", F.col("specialty_te").alias("a")).join(again.select("id", F.col("specialty_te").alias("b")), "id").where("abs(a - b) > 1e-9").count()
    assert differ > 0  # training rows are not encoded with the full mapping
    other = p.transform(spark.createDataFrame([(1, None, "Unseen", None, 0, 0)], df.schema)).first()
    assert other["specialty_te"] == pytest.approx(p.mappings["specialty"][1]) and other["freq"] == p.medians["freq"]


def test_manufacturer_risk_does_not_leak(spark):
    pairs = [(i, "BigCo", 3, 30.0) for i in range(200)] + [(999, "SoloCo", 5, 50.0)]
    labels = [(i, int(i < 20), i % 5) for i in range(200)] + [(999, 1, 0)]
    p, y = spark.createDataFrame(pairs, "npi long, manufacturer string, payment_count long, amount double"), spark.createDataFrame(labels, "npi long, is_excluded int, fold int")
    risk = {r["npi"]: r["risk"] for r in rows(encoders.manufacturer_risk(p, y))}
    assert risk[999] < 2 * (65 / 605) and risk[999] < (5 + 50 * 65 / 605) / 55
    w = spark.createDataFrame([(1, 0.2, 300.0), (1, 0.6, 100.0), (2, 0.1, 0.0), (2, 0.3, 0.0)], "npi long, e double, w double")
    assert {r["npi"]: r["r"] for r in rows(providers.weighted_mean(w, "npi", "e", "w", "r"))} == {1: pytest.approx(0.3), 2: pytest.approx(0.2)}


def test_split_features_of_test_providers(spark):
    who = spark.createDataFrame([(i, int(i < 30), "ab"[i % 2], float(i)) for i in range(300)], "npi long, is_excluded int, specialty string, x double")
    pairs = spark.createDataFrame([(i, ["SoloCo", "BigCo"][i % 2], 2, 100.0) for i in range(299)], "npi long, manufacturer string, payment_count long, amount double")
    a, b = experiments.split_features(who.where("npi % 4 <> 0"), who.where("npi % 4 = 0"), pairs, ["x"])
    assert a.columns == b.columns == ["npi", "is_excluded", "x", "specialty_te", "manufacturer_weighted_risk"]
    assert a.count() == 225 and b.count() == 75 and a.union(b).dropna().count() == 300


# ---------------------------------------------------------------- metrics


def brute(y, s):
    order = sorted(set(s), reverse=True)
    p, n = sum(y), len(y) - sum(y)
    ap = last = 0.0
    for t in order:
        hit = [b for a, b in zip(s, y, strict=True) if a >= t]
        ap += (sum(hit) / p - last) * sum(hit) / len(hit)
        last = sum(hit) / p
    pairs = [(a > b) + 0.5 * (a == b) for a, ya in zip(s, y, strict=True) if ya for b, yb in zip(s, y, strict=True) if not yb]
    return ap, sum(pairs) / (p * n)


def test_average_precision_and_auc(spark):
    rng = np.random.default_rng(4)
    for n, ties in ((4, 3), (60, 5), (300, 1000)):
        y, s = [1, 0, *rng.integers(0, 2, n).tolist()], (rng.integers(0, ties, n + 2) / ties).tolist()
        df = spark.createDataFrame(list(zip(y, s, strict=True)), "y int, s double")
        r = metrics.summary(df, "s", "y").first()
        ap, auc = brute(y, s)
        assert r["average_precision"] == pytest.approx(ap) and r["roc_auc"] == pytest.approx(auc)
    gap = metrics.memorization_gap(spark.createDataFrame([(0.9, 1), (0.1, 0), (0.1, 0), (0.1, 0)], "s double, y int"), spark.createDataFrame([(0.1, 1), (0.9, 0), (0.5, 0), (0.2, 0)], "s double, y int"), "s", "y").first()
    assert tuple(gap) == (1.0, 0.25, 4.0)
    one = spark.createDataFrame([(0.5, 0), (0.2, 0)], "s double, y int")
    assert metrics.summary(one, "s", "y").first()["roc_auc"] is None


def test_single_features(spark):
    df = spark.createDataFrame([(int(i < 10), float(i < 10), float(i >= 10)) for i in range(100)], "y int, good double, bad double")
    got = {r["feature"]: r for r in rows(metrics.single_feature_baselines(df, ["good", "bad", "absent"], "y"))}
    assert set(got) == {"good", "bad"} and got["good"]["roc_auc"] == 1.0 and got["bad"]["roc_auc"] == 0.0 and got["good"]["lift"] == pytest.approx(10)


def test_thresholds(spark):
    df = spark.createDataFrame([(0.724, 1), (0.7239999, 0), (1.0, 1), (0.0, 0)], "s double, y int")
    sweep = metrics.threshold_sweep(df, "s", "y")
    got = {round(r["threshold"], 3): (r["tp"], r["fp"], r["fn"]) for r in rows(sweep)}
    assert len(got) == 1001 and got[0.724] == (2, 0, 0) and got[0.723] == (2, 1, 0) and got[1.0] == (1, 0, 1) and got[0.0] == (2, 2, 0)
    best = {r["selection"]: r["threshold"] for r in rows(metrics.selections(sweep))}
    assert best == {"best_f1": 0.724, "best_precision": 0.724, "best_recall": 0.0}
    assert metrics.nearest_threshold(sweep, 0.50049).first()["threshold"] == 0.5
    r = metrics.confusion(df, "s", "y", 0.724).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"], r["f1"]) == (2, 0, 0, 2, 1.0)


def test_anomaly_ranks(spark):
    df = spark.createDataFrame([(float(i), int(i in (99, 50))) for i in range(100)], "s double, y int")
    r = metrics.anomaly_capture(df, "s", "y").first()
    assert (r["top_1_captured"], r["top_10_captured"], r["mean_score_positive"], r["n_positive"]) == (1, 1, 74.5, 2)
    r = metrics.anomaly_capture(df.where("y = 0"), "s", "y").first()
    assert r["n_positive"] == 0 and r["mean_score_positive"] is None


# ---------------------------------------------------------------- statistics


def test_standardised_rates(spark):
    data = [("PsychPharma", "Psychiatry", int(i < 20)) for i in range(1000)] + [("OtherCo", "Psychiatry", int(i < 20)) for i in range(1000)] + [("OtherCo", "Dermatology", int(i < 2)) for i in range(2000)]
    got = {r["grp"]: r for r in rows(stats.smr_intervals(stats.standardized_rates(spark.createDataFrame(data, "m string, s string, y int"), "m", "s", "y")))}
    assert got["PsychPharma"]["smr"] == pytest.approx(1.0) and got["PsychPharma"]["verdict"] == "explained by specialty mix"
    data = [(m, "s", int(i < k)) for m, k in (("RiskyCo", 60), ("CleanCo", 2)) for i in range(2000)]
    got = {r["grp"]: r["verdict"] for r in rows(stats.smr_intervals(stats.standardized_rates(spark.createDataFrame(data, "m string, s string, y int"), "m", "s", "y")))}
    assert got == {"RiskyCo": "above", "CleanCo": "below"}
    assert stats.poisson_interval(0)[0] == 0 and stats.poisson_interval(10) == (pytest.approx(4.795, abs=1e-3), pytest.approx(18.390, abs=1e-3))


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(i < 30), float(i < 30), float(rng.random())) for i in range(330)], "y int, a double, b double")
    r = stats.paired_bootstrap(df, "y", "a", "b", 200).first()
    assert r["ci_low"] > 0 and r["share_not_better"] == 0
    r = stats.paired_bootstrap(df, "y", "a", "a", 50).first()
    assert (r["observed"], r["share_not_better"]) == (0.0, 1.0)


def test_one_sd_rule_and_grid(spark):
    df = spark.createDataFrame([(3, 0.10, 0.02), (2, 0.09, 0.02), (1, 0.081, 0.01), (0, 0.05, 0.01)], "max_depth int, mean double, std double")
    assert stats.one_sd_choice(df, ["max_depth"]).first()["max_depth"] == 1
    configs = models.grid_configs()
    assert len(configs) == 81 and min(configs, key=models.complexity) == {"max_depth": 1, "min_child_weight": 200, "reg_lambda": 50, "n_estimators": 100}
    with pytest.raises(TimeoutError):
        models.search(configs[:1], [(df, df)], lambda *a: 0.0, seconds=-1)


# ---------------------------------------------------------------- EDA and dashboard


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 1), (20.0, 0), (20.5, 1), (-1.0, 1), (0.5, 0), (None, 0)], "v double, f int")
    got = {r["bin"]: (r["flagged"], r["other"]) for r in rows(eda.histogram(df, "v", 0, 20, 40, "f"))}
    assert len(got) == 40 and got[0] == (1, 0) and got[39] == (0, 1) and got[1] == (0, 1) and sum(map(sum, got.values())) == 3


def test_lift_crosstab_and_missing(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 0, "x"), (0, 0, "y"), (0, 0, None)], "y int, f int, c string")
    r = eda.flag_lift(df, ["f"], "y").first()
    assert (r["rate_positive"], r["rate_negative"], r["lift"]) == (0.5, 0.0, float("inf"))
    assert eda.crosstab(df, "y", "f").first()["both"] == 1
    assert {r["column_name"]: r["pct_null"] for r in rows(eda.missingness(df, ["y", "c"]))} == {"y": 0.0, "c": 50.0}
    top = rows(dashboard.top_categories(df, F.col("c"), "y", 2))
    assert [r["category"] for r in top] == ["Missing", "x"]
    assert dashboard.overall(df.where("y = 0"), "f", "y").first()["recall"] is None


def test_concentration_counts_equal_sizes_once(spark):
    df = spark.createDataFrame([(k,) for k, n in (("a", 60), ("b", 20), ("c", 10), ("d", 10)) for _ in range(n)], "k string")
    r = eda.concentration(df, "k").first()
    assert (r["n_categories"], r["n_to_share"], r["median_rows"], r["n_small"]) == (4, 3, 15.0, 4)


# ---------------------------------------------------------------- models, sources, streaming


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=2))) for i in range(400)] + [(999, 9.0, -9.0)], "id long, a double, b double")
    forest = isolation_forest.fit(df, ["a", "b"], "id", trees=40)
    top = isolation_forest.score(df, forest, ["a", "b"], "id").orderBy(F.desc("anomaly_score")).first()
    assert top["id"] == 999 and top["anomaly_score"] > 0.6 and len(isolation_forest.fit(df, ["a", "b"], "id", trees=40)) == 40


def test_models_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 7)) for i in range(200)], "id long, x double, y int")
    model = models.train(df, ["x"], "y", models.logistic("y"), True)
    artifacts.save_model(model, str(tmp_path / "m"))
    assert models.evaluate(models.scores(model, df, "id", "y"), "y")["roc_auc"] == 1.0
    tree = models.train(df, ["x"], "y", models.forest("y", 5, 3))
    assert models.importances(tree, ["x"]) == [("x", 1.0)] and models.imbalance(df, "y") == 4.0


def test_artifact_gate(tmp_path):
    assert artifacts.resolve_suffix("trial", False) == "_trial" and artifacts.resolve_suffix("", True) == ""
    for bad in (("", False), ("trial", True)):
        with pytest.raises(ValueError):
            artifacts.resolve_suffix(*bad)
    value = {"mapping": {"a": 0.5}, "mean": 0.1, "columns": ["x"]}
    artifacts.save_artifact(value, str(tmp_path / "deep" / "a.json"))
    assert artifacts.load_artifact(str(tmp_path / "deep" / "a.json")) == value


def test_sources(spark, tmp_path):
    (tmp_path / "l.csv").write_text("NPI,LAST\n,Smith\n0012,\n")
    assert {tuple(r) for r in io.read_strings(spark, str(tmp_path / "l.csv"), ["NPI", "LAST"]).collect()} == {("", "Smith"), ("0012", "")}
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    io.write_table(df, str(tmp_path / "t"), "k", 2)
    io.write_csv(df, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), "k long, v string", ["k"]).count() == spark.read.parquet(str(tmp_path / "t")).count() == 2
    io.write_bucketed(df, "bucketed_pairs", "k", 2)
    assert io.pairs_of(spark.table("bucketed_pairs"), df.where("k = 1"), "k").count() == 1
    (tmp_path / "raw").mkdir()
    for n in ("x.csv", ".gitkeep"):
        (tmp_path / "raw" / n).write_text("1")
    copy = io.cached((tmp_path / "raw" / "x.csv").as_uri(), str(tmp_path / "cache" / "x.csv"))
    assert open(copy).read() == "1" and io.clear_cache(str(tmp_path / "raw")) == 1


def test_streaming_counts(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (None,)], "npi long").write.parquet(str(tmp_path / "in"))
    q = incremental.running_frequency(incremental.payment_stream(spark, str(tmp_path / "in"), "npi long")).writeStream.outputMode("complete").format("memory").queryName("freq").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.table("freq").collect()} == {(1, 2)}
    finally:
        q.stop()


# ---------------------------------------------------------------- quantiles, labels, boosting


def test_quantiles_match_pandas(spark):
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"g": rng.integers(0, 3, 3000), "v": rng.integers(0, 900, 3000) / 7})
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = {r["g"]: [r[f"p{i}"] for i in range(len(probs))] for r in ranks.quantiles(spark.createDataFrame(f), ["g"], "v", probs).collect()}
    for g, own in f.groupby("g"):
        assert np.allclose(got[g], own.v.quantile(probs))
    one = spark.createDataFrame([(4.0,), (None,)], "v double")
    assert ranks.quantiles(one, [], "v", [0.3]).first()["p0"] == 4.0 and ranks.quantiles(one.where("false"), [], "v", [0.5]).first()["p0"] is None


def test_rows_without_fold_are_a_fold_of_their_own(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 1), ("a", 1, None), ("b", 0, None)], "c string, y int, fold int")
    out = encoders.out_of_fold(df, "c", "y", "fold", "e", m=1.0)
    assert out.count() == 4 and {r["fold"]: r["e"] for r in out.collect() if r["c"] == "a"}[None] == (1 + 0.5) / 3


def test_label_table(spark):
    paid = spark.createDataFrame([(1, 10, "Smith", "John", "TX"), (2, None, "SMYTH", "jon", "tx"), (3, 0, "Doe", "Ann", "CA"), (4, 11, "", "", "TX"), (5, 12, "Smith", "John", "TX"), (6, 13, None, None, None)], "record_id int, npi int, last string, first string, state string")
    listed = spark.createDataFrame([(10, "Other", "Name", "TX"), (0, "Smith", "John", "TX"), (None, "Doe", "Bob", "CA"), (12, "Doe", "Ann", "CA")], "npi int, last string, first string, state string")
    got = {r["record_id"]: (r["is_excluded"], r["is_excluded_name_match"], r["match_confidence"]) for r in linkage.label_table(paid, listed).collect()}
    assert got[1] == (1, 1, 1.0) and got[5] == (1, 1, 1.0) and got[2][0] == 0
    assert got[3] == (0, 0, 0.0) and got[4] == (0, 0, 0.0) and got[6] == (0, 0, 0.0)  # Ann Doe has an id on the list


def test_boosted_trees_and_their_grid(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(float)
    x[::50, 2] = np.nan
    full = boosting.fit(x, y, n_estimators=60, max_depth=3)
    assert boosting.roc_auc(y, full.predict(x)) > 0.98 and full.gain[2] < full.gain[:2].min()
    assert boosting.fit(x, y, n_estimators=5, min_child_weight=1e9).gain.sum() == 0
    tight = [np.abs(boosting.fit(x, y, n_estimators=1, max_depth=2, reg_lambda=r).value).max() for r in (0.0, 100.0, 1e6)]
    assert tight[0] > tight[1] > tight[2]
    # one Newton step of one split is what the formula says
    stump = boosting.fit(np.array([[0.0], [0.0], [1.0], [1.0]]), np.array([0.0, 1.0, 1.0, 1.0]), n_estimators=1, max_depth=1, learning_rate=1.0, reg_lambda=0.0, min_child_weight=0.0, scale_pos_weight=1.0)
    assert np.allclose(stump.logits(np.array([[0.0], [1.0]])), [0.0, 2.0])
    rows = [(i, int(y[i]), *map(float, np.nan_to_num(x[i]))) for i in range(600)]
    df = spark.createDataFrame(rows, "npi int, y int, a double, b double, c double")
    folds = [(df.where(f"npi % 3 <> {i}"), df.where(f"npi % 3 = {i}")) for i in range(2)]
    configs = models.grid_configs({"max_depth": [1, 3], "min_child_weight": [1, 20], "reg_lambda": [1], "n_estimators": [20]})
    out = boosting.grid_search(spark, folds, configs, ["a", "b", "c"], "y", "npi")
    r = experiments.separability(out, list(configs[0])).first()
    assert out.count() == 8 and r["spread_all_means"] > 0 and r["selected_max_depth"] == 3 and r["n_within_one_sd"] >= 1
    scored = df.select("y", boosting.score(boosting.train(df, ["a", "b", "c"], "y", "npi", n_estimators=20), ["a", "b", "c"]).alias("s"))
    assert models.evaluate(scored.withColumnRenamed("s", "score"), "y")["roc_auc"] > 0.95
    assert abs(boosting.average_precision(np.array([1.0, 0, 1]), np.array([0.9, 0.8, 0.8])) - (0.5 + 0.5 * 2 / 3)) < 1e-12


def test_grid_fits_once_for_all_numbers_of_trees(spark):
    """Each row of a grid over n_estimators is what a fit of its own gives, though one fit serves all."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(300)], "npi int, y int, a double, b double")
    sides = df.where("npi % 3 <> 0"), df.where("npi % 3 = 0")
    configs = models.grid_configs({"n_estimators": [30, 5, 12], "max_depth": [2]})
    (a, ya), (b, yb) = (boosting.held(side, ["a", "b"], "y", "npi") for side in sides)
    alone = {c["n_estimators"]: boosting.fit(a, ya, **(boosting.DEFAULTS | c)).predict(b) for c in configs}
    out = {r["n_estimators"]: (r["average_precision"], r["roc_auc"]) for r in boosting.grid_search(spark, [sides], configs, ["a", "b"], "y", "npi").collect()}
    assert out == {n: (boosting.average_precision(yb, s), boosting.roc_auc(yb, s)) for n, s in alone.items()}
    staged = boosting.fit(a, ya, **(boosting.DEFAULTS | {"n_estimators": 30, "max_depth": 2})).predict_staged(b, [5, 12, 30])
    assert all((s == alone[n]).all() for n, s in zip((5, 12, 30), staged, strict=True))


def _many(spark):
    """250,000 rows, all but 12,500 positive: a is 0 where one in ten is negative, else 1."""
    return spark.range(250_000).select(F.col("id").alias("npi"), (F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 20 != 0).cast("int").alias("y"))


def test_a_fit_counts_all_rows(spark):
    """One Newton step on 250,000 rows of both classes, though more than 200,000 of them are positive."""
    step = {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0, "reg_lambda": 0.0, "min_child_weight": 0.0, "scale_pos_weight": 1.0}
    trees = boosting.train(_many(spark), ["a"], "y", "npi", **step)
    assert np.allclose(trees.logits(np.array([[0.0], [1.0]])), [2 * (112_500 - 12_500) / 125_000, 2.0], rtol=1e-12)


def test_a_grid_measures_all_rows(spark):
    """Of a second side of 250,000 rows, more than 200,000 of them positive, and of one without rows."""
    df = _many(spark)
    configs = models.grid_configs({"n_estimators": [1, 2], "max_depth": [1]})
    out = {(r["fold"], r["n_estimators"]): (r["average_precision"], r["roc_auc"]) for r in boosting.grid_search(spark, [(df, df), (df, df.where("npi < 0"))], configs, ["a"], "y", "npi").collect()}
    share = 125_000 / 237_500
    for n in (1, 2):
        assert np.allclose(out[0, n], (share + (1 - share) * 0.95, (125_000 + 112_500 / 2) / 237_500), rtol=1e-12)
        assert out[1, n][0] == 0 and np.isnan(out[1, n][1] if out[1, n][1] is not None else np.nan)


def test_fits_of_cells_are_fits_of_rows(spark, monkeypatch):
    """Missing, infinite, many and equal values: the trees of the dealt fit are those of the rows in memory, to the bit, and of arrays in files."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=3000), np.round(rng.normal(size=3000), 1)
    y = (a + b + rng.normal(size=3000) > 1).astype(int)
    a[::40], a[1::300], b[::7] = np.nan, np.inf, np.nan
    rows = [(i, int(y[i]), float(a[i]), None if np.isnan(b[i]) else float(b[i]), 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "npi int, y int, a double, b double, c double")
    own = {"n_estimators": 8, "max_depth": 4, "min_child_weight": 3.0}
    got, wanted = boosting.train(df, ["a", "b", "c"], "y", "npi", **own), boosting.fit(*boosting.held(df, ["a", "b", "c"], "y", "npi"), **own)
    monkeypatch.setattr(boosting, "IN_MEMORY", 1)
    filed = boosting.fit(*boosting.held(df, ["a", "b", "c"], "y", "npi"), **own)
    assert (got.feature >= 0).sum() > 50 and all((getattr(x, f) == getattr(wanted, f)).all() for x in (got, filed) for f in ("feature", "threshold", "value", "gain"))


def test_weights_that_choose_alike_are_one_fit():
    """Fits of several least weights equal fits of their own to the bit, and are one where they choose the same splits."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(400, 3)), 1)
    y = (x[:, 0] + rng.normal(size=400) > 1).astype(float)
    own = {"n_estimators": 20, "max_depth": 3, "reg_lambda": 2}
    least = [0.0, 1e-9, 20.0, 60.0]
    shared = boosting.fit_each(x, y, least, **own)
    for w, a in zip(least, shared, strict=True):
        b = boosting.fit(x, y, min_child_weight=w, **own)
        assert all((getattr(a, f) == getattr(b, f)).all() for f in ("feature", "threshold", "value", "gain"))
    assert shared[0] is shared[1] and len({id(a) for a in shared}) == 3


def test_folds_in_one_pass_are_what_each_fold_gives(spark):
    """Deals give the folds of the rest, and one pass over the pairs the features that split_features gives for each fold."""
    rng = np.random.default_rng(5)
    who = spark.createDataFrame([(i, int(rng.random() < 0.3), str(rng.choice(["a", "b", "c"])) if i % 7 else None, float(i)) for i in range(230)], "npi long, is_excluded int, specialty string, x double")
    dealt = [(npi, m) for npi in range(220) for m in rng.choice(12, 3, replace=False).tolist()]
    pairs = spark.createDataFrame([(npi, m or None, int(rng.integers(1, 5)), 0.0 if npi < 9 else float(rng.integers(1, 99))) for npi, m in dealt], "npi long, manufacturer long, payment_count long, amount double")
    folded = sampling.folds(who, "npi", "is_excluded")
    deals = {r["npi"]: r["deal"] for r in sampling.nested_folds(who, "npi", "is_excluded").collect()}
    found = experiments.fold_features(who, pairs, ["x"])
    for i, sides in enumerate(found):
        rest, own = folded.where(F.col("fold") != i).drop("fold"), folded.where(F.col("fold") == i).drop("fold")
        assert {r["npi"]: r["fold"] for r in sampling.folds(rest, "npi", "is_excluded").collect()} == {npi: g for npi, d in deals.items() if (g := sampling.inner_fold(d, i)) is not None}
        for got, wanted in zip(sides, experiments.split_features(rest, own, pairs, ["x"]), strict=True):
            assert got.schema.names == wanted.schema.names
            a, b = (np.array([tuple(r) for r in df.orderBy("npi").collect()]) for df in (got, wanted))
            assert a.shape == b.shape and np.allclose(a, b, atol=1e-6)


def test_dashboard_document_has_a_sweep_for_each_model(spark):
    df = spark.createDataFrame([(0.9, 1, 1, "a"), (0.2, 0, 0, None), (0.6, 1, 0, "a")], "score double, flag int, y int, c string")
    doc = json.loads(dashboard.summary(df, "score", "flag", "y", ["c"], {"forest": df, "trees": df.where("score > 0.5")}))
    assert doc["overall"]["n_payments"] == 3 and set(doc["threshold_sweep"]) == {"forest", "trees"} and doc["c"][0]["category"] == "a"
    assert len(doc["threshold_sweep"]["trees"]["recall"]) == 1001 and doc["threshold_sweep"]["trees"]["precision"][0] == 0.5


def test_features_against_the_full_model(spark):
    df = spark.createDataFrame([(1, 0.9, 0.1), (0, 0.1, 0.9), (1, 0.8, 0.2), (0, 0.2, 0.3)], "y int, a double, b double")
    got = {r["feature"]: r["beats_full_model_roc"] for r in metrics.single_feature_baselines(df, ["a", "b"], "y", 0.7).collect()}
    assert got == {"a": True, "b": False}
