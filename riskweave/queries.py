"""The engine's queries over the test tables, each with the SQL it has to agree with.

A line item with its order, customer and part plays the part of a payment: the customer is the provider, the supplier
the manufacturer, the brand the specialty, the return flag and line status the nature; customers in debt are the
excluded ones. Fractions are rounded half up at six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import exprs as X
from riskweave.operators import dashboard, eda, encoders, linkage, metrics, payments, providers, sampling, stats
from riskweave.plans import boosting, experiments, isolation_forest, models
from riskweave.sources.io import dealt, kept, pairs_of, table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

NATURES = ["AF", "AO", "NF", "NO", "RF"]

PAY = """payments AS (SELECT o_orderkey AS record_id, o_custkey AS npi, l_suppkey AS manufacturer, nullif(p_brand, 'Brand#4') AS specialty,
 l_returnflag || l_linestatus AS nature, o_orderpriority AS form, l_extendedprice AS amount, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS related,
 CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS third_party, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_excluded
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
LABELS = "providers AS (SELECT DISTINCT o_custkey AS npi, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_excluded FROM orders JOIN customer ON o_custkey = c_custkey)"
SCORED = PAY + """, scored AS (SELECT npi, max(is_excluded) AS is_excluded, sum(CASE WHEN nature LIKE 'R%' THEN 1 ELSE 0 END)::DOUBLE / count(*) AS score FROM payments GROUP BY npi)"""
HASH = "('0x' || substr(md5(npi::VARCHAR || ':42'), 1, 8))::BIGINT"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY is_excluded ORDER BY " + HASH + ", npi) AS rn, count(*) OVER (PARTITION BY is_excluded) AS stratum_n FROM providers)"


def r6(sql: str) -> str:
    return f"floor(({sql}) * 1e6 + 0.5) / 1e6"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: X.r6(F.col(c)) for c in columns})


# ---------------------------------------------------------------- views


def pay(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice")
    order = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    out = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return out.select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("npi"), F.col("l_suppkey").alias("manufacturer"), F.nullif(F.col("p_brand"), F.lit("Brand#4")).alias("specialty"), F.concat("l_returnflag", "l_linestatus").alias("nature"), F.col("o_orderpriority").alias("form"), F.col("l_extendedprice").alias("amount"),
        (F.col("p_size") % 2 == 0).cast("int").alias("related"), (F.col("p_type") == "PROMO").cast("int").alias("third_party"), (F.col("c_acctbal") < 0).cast("int").alias("is_excluded"),
    )


def provider_labels(spark: SparkSession, d: str) -> DataFrame:
    who = table(spark, d, "orders").select(F.col("o_custkey").alias("npi")).distinct()
    return who.join(table(spark, d, "customer"), F.col("npi") == F.col("c_custkey")).select("npi", (F.col("c_acctbal") < 0).cast("int").alias("is_excluded"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    hit = F.sum(F.col("nature").startswith("R").cast("int"))
    return pay(spark, d).groupBy("npi").agg(F.max("is_excluded").alias("is_excluded"), X.divide(hit, F.count("*")).alias("score"))


# ---------------------------------------------------------------- providers


@query(f"""WITH {PAY}, base AS (SELECT npi, max(is_excluded) AS is_excluded, count(*) AS total_payment_count, sum(amount::DECIMAL(18,2))::DOUBLE AS total_payment_amount,
 {r6("avg(ln(1 + amount))")} AS mean_payment_amount_log, {r6("median(ln(1 + amount))")} AS median_payment_amount_log, {r6("avg(related)")} AS share_related_product, {r6("avg(third_party)")} AS share_third_party_payment FROM payments GROUP BY npi),
 spec AS (SELECT npi, coalesce(specialty, 'Missing') AS s, count(*) AS n FROM payments GROUP BY ALL),
 top AS (SELECT npi, s AS recipient_specialty, row_number() OVER (PARTITION BY npi ORDER BY n DESC, s) AS rn, count(*) OVER (PARTITION BY npi) AS n_specialty FROM spec),
 pairs AS (SELECT npi, manufacturer, sum(amount::DECIMAL(18,2)) AS amount FROM payments GROUP BY ALL),
 conc AS (SELECT npi, count(*) AS n_distinct_manufacturers, {r6("max(amount)::DOUBLE / nullif(sum(amount)::DOUBLE, 0)")} AS top_manufacturer_amount_share FROM pairs GROUP BY npi),
 mix AS (SELECT npi, {", ".join(f"{r6(f'''avg(CASE WHEN nature = '{n}' THEN 1 ELSE 0 END)''')} AS share_nature_{n}" for n in NATURES)} FROM payments GROUP BY npi)
 SELECT base.*, recipient_specialty, n_specialty, n_distinct_manufacturers, top_manufacturer_amount_share, {", ".join(f"share_nature_{n}" for n in NATURES)} FROM base JOIN top USING (npi) JOIN conc USING (npi) JOIN mix USING (npi) WHERE rn = 1""")
def provider_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = providers.provider_features(pay(spark, d), NATURES)
    return rounded(out, "mean_payment_amount_log", "median_payment_amount_log", "share_related_product", "share_third_party_payment", "top_manufacturer_amount_share", *(f"share_nature_{n}" for n in NATURES))


@query(f"""WITH {PAY}, c AS (SELECT npi, coalesce(specialty, 'Missing') AS s, count(*) AS n FROM payments GROUP BY ALL)
 SELECT npi, s AS recipient_specialty, n_specialty FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY n DESC, s) AS rn, count(*) OVER (PARTITION BY npi) AS n_specialty FROM c) WHERE rn = 1""")
def provider_specialty_mode(spark: SparkSession, d: str) -> DataFrame:
    return providers.mode(pay(spark, d), "specialty", "recipient_specialty")


@query(f"WITH {PAY} SELECT npi, manufacturer, count(*) AS payment_count, sum(amount::DECIMAL(18,2))::DOUBLE AS amount FROM payments GROUP BY ALL")
def provider_manufacturer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return providers.manufacturer_pairs(pay(spark, d))


@query(f"WITH {PAY} SELECT npi, {', '.join(f'''{r6(f'avg(CASE WHEN nature = {chr(39)}{n}{chr(39)} THEN 1 ELSE 0 END)')} AS share_nature_{n}''' for n in NATURES)} FROM payments GROUP BY npi")
def provider_nature_mix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(providers.nature_mix(pay(spark, d), NATURES), *(f"share_nature_{n}" for n in NATURES))


@query(f"""WITH {PAY}, p AS (SELECT npi, sum(amount::DECIMAL(18,2)) AS amount, manufacturer FROM payments GROUP BY ALL)
 SELECT npi, count(*) AS n_distinct_manufacturers, {r6("max(amount)::DOUBLE / nullif(sum(amount)::DOUBLE, 0)")} AS top_manufacturer_amount_share FROM p GROUP BY npi""")
def provider_concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(providers.concentration(providers.manufacturer_pairs(pay(spark, d))), "top_manufacturer_amount_share")


@query("""SELECT o_orderkey AS record_id, o_totalprice AS payment_amount, floor(ln(1 + greatest(o_totalprice - 1000, 0)) * 1e6 + 0.5) / 1e6 AS payment_amount_log, o_orderpriority AS payment_form, month(o_orderdate)::INT AS payment_month,
 (isodow(o_orderdate) - 1)::INT AS payment_day_of_week, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_charity, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS is_third_party_payment, n AS payment_frequency
 FROM orders JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = o_custkey""")
def payment_features(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    src = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("npi"), F.col("o_totalprice").alias("paid"), (F.col("o_totalprice") - 1000).alias("amount"), F.lit(1).alias("n_payments"), F.col("o_orderpriority").alias("form"), F.lit(None).cast("string").alias("nature"), F.lit(None).cast("string").alias("specialty"), F.lit(None).cast("string").alias("manufacturer"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("date_text"), F.lit("No").alias("ownership"), F.when(status == "O", "No Third Party Payment").when(status == "P", "Entity").alias("third_party"), F.when(status == "F", "Yes").alias("charity"), F.lit(None).cast("string").alias("related"), F.lit(None).cast("string").alias("disputed"))
    out = payments.payment_features(src)
    return out.select("record_id", (F.col("payment_amount") + 1000).alias("_p"), X.r6(F.col("payment_amount_log")).alias("payment_amount_log"), "payment_form", "payment_month", "payment_day_of_week", "is_charity", "is_third_party_payment", "payment_frequency").join(src.select("record_id", F.col("paid").alias("payment_amount")), "record_id").drop("_p")


@query("SELECT o_custkey AS npi, count(*) AS payment_frequency FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def payment_frequency(spark: SparkSession, d: str) -> DataFrame:
    return payments.payment_frequency(table(spark, d, "orders").select(F.col("o_custkey").alias("npi")))


@query("""SELECT o_orderkey AS record_id, o_totalprice AS amount, CASE WHEN c_custkey IS NULL THEN NULL WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_excluded FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey""")
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    labels = orders.join(table(spark, d, "customer").where("c_custkey % 3 <> 0"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("record_id"), (F.col("c_acctbal") < 0).cast("int").alias("is_excluded"))
    return payments.feature_table(orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("amount")), labels)


# ---------------------------------------------------------------- linkage


@query("""SELECT o_orderkey AS record_id, o_custkey AS npi, CASE WHEN o_custkey <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 1 ELSE 0 END AS is_excluded FROM orders""")
def label_exact_match(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    return linkage.exact_flag(table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("npi")), listed, "npi", "c_custkey")


DICE = """CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0.0::DOUBLE END"""
NAMES = """clean AS (SELECT p_partkey, p_type AS state, trim(regexp_replace(regexp_replace(upper(trim(split_part(p_name, ' ', 2))), '[^A-Z\\s]', '', 'g'), '\\s+', ' ', 'g')) AS last,
 trim(regexp_replace(regexp_replace(upper(trim(split_part(p_name, ' ', 1))), '[^A-Z\\s]', '', 'g'), '\\s+', ' ', 'g')) AS first FROM part),
 grams AS (SELECT *, CASE WHEN length(last) >= 2 THEN list_distinct(list_transform(range(1, length(last)), lambda i: substr(last, i, 2))) WHEN length(last) = 1 THEN [last] ELSE [] END AS lg,
 CASE WHEN length(first) >= 2 THEN list_distinct(list_transform(range(1, length(first)), lambda i: substr(first, i, 2))) WHEN length(first) = 1 THEN [first] ELSE [] END AS fg FROM clean)"""


@query(f"""WITH {NAMES}, people AS (SELECT DISTINCT state, last, first, lg, fg FROM grams), listed AS (SELECT DISTINCT state, last, first, lg, fg FROM grams WHERE p_partkey % 40 = 7 AND last <> ''),
 pairs AS (SELECT p.state, p.last, p.first, {DICE.format(a="p.lg", b="l.lg")} AS dl, {DICE.format(a="p.fg", b="l.fg")} AS df FROM people p JOIN listed l ON p.state = l.state AND substr(p.last, 1, 2) = substr(l.last, 1, 2)),
 best AS (SELECT state, last, first, max(dl * 0.6::DOUBLE + df * 0.4::DOUBLE) AS best FROM pairs WHERE dl >= 0.5 AND df >= 0.5 GROUP BY ALL)
 SELECT p.state, p.last, p.first, CASE WHEN best >= 0.65 THEN 1 ELSE 0 END AS is_match, coalesce(floor(best * 1e4 + 0.5) / 1e4, 0) AS confidence FROM people p LEFT JOIN best USING (state, last, first)""")
def label_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_partkey", X.normalize_state(F.col("p_type")).alias("state"), X.normalize_name(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("last"), X.normalize_name(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("first"))
    return linkage.fuzzy_matches(names, names.where("p_partkey % 40 = 7"))


@query(f"""WITH {NAMES}, ids AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey % 50 END AS npi FROM part), named AS (SELECT * FROM grams JOIN ids USING (p_partkey)),
 listed AS (SELECT * FROM named WHERE p_partkey % 40 = 7), unnamed AS (SELECT * FROM listed WHERE coalesce(npi, 0) = 0 AND last <> ''),
 pairs AS (SELECT p.p_partkey, {DICE.format(a="p.lg", b="l.lg")} AS dl, {DICE.format(a="p.fg", b="l.fg")} AS df FROM named p JOIN unnamed l ON p.state = l.state AND p.last <> '' AND substr(p.last, 1, 2) = substr(l.last, 1, 2)),
 best AS (SELECT p_partkey, max(dl * 0.6::DOUBLE + df * 0.4::DOUBLE) AS best FROM pairs WHERE dl >= 0.5 AND df >= 0.5 GROUP BY 1)
 SELECT p_partkey AS record_id, npi, CASE WHEN npi <> 0 AND npi IN (SELECT npi FROM listed WHERE npi IS NOT NULL) THEN 1 ELSE 0 END AS is_excluded, CASE WHEN best >= 0.65 THEN 1 ELSE 0 END AS is_excluded_name_match,
 coalesce(floor(best * 1e4 + 0.5) / 1e4, 0) AS match_confidence FROM named LEFT JOIN best USING (p_partkey)""")
def label_table(spark: SparkSession, d: str) -> DataFrame:
    npi = F.when(F.col("p_size") % 3 != 0, F.col("p_partkey") % 50).alias("npi")
    src = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), npi, F.split_part("p_name", F.lit(" "), F.lit(2)).alias("last"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), F.col("p_type").alias("state"))
    return linkage.label_table(src, src.where("record_id % 40 = 7")).drop("last", "first", "state")


@query(f"""SELECT count(*) AS n_rows, sum(e)::BIGINT AS n_exact, sum(f)::BIGINT AS n_fuzzy, sum(e * f)::BIGINT AS n_both, {r6("sum(e)::DOUBLE / count(*)")} AS exact_rate FROM (SELECT CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS e, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS f FROM customer)""")
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    return linkage.label_summary(table(spark, d, "customer").select((F.col("c_acctbal") < 0).cast("int").alias("e"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("f")), "e", "f")


@query("""WITH a AS (SELECT o_orderkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS record_id, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> 1 OR coalesce(b.n, 0) <> 1""")
def record_alignment_check(spark: SparkSession, d: str) -> DataFrame:
    return linkage.misaligned(table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("record_id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id")), "record_id")


@query("SELECT o_orderkey AS record_id, o_custkey AS npi FROM orders WHERE o_orderstatus = 'F'")
def attach_provider_ids(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnsRenamed({"o_orderkey": "record_id", "o_custkey": "npi"})
    return linkage.attach_ids(orders.where("o_orderstatus = 'F'").select("record_id"), orders, "record_id", "npi")


@query("SELECT DISTINCT l_orderkey AS record_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def set_difference_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id")).distinct()
    return keys.join(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("record_id")), "record_id", "left_anti")


@query(f"WITH {PAY}, {LABELS} SELECT npi, manufacturer, count(*) AS payment_count, sum(amount::DECIMAL(18,2))::DOUBLE AS amount FROM payments WHERE npi IN (SELECT npi FROM providers WHERE is_excluded = 1) GROUP BY ALL")
def sampled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(providers.manufacturer_pairs(pay(spark, d)), provider_labels(spark, d).where("is_excluded = 1"), "npi")


# ---------------------------------------------------------------- samples and splits


@query(f"WITH {LABELS} SELECT * FROM providers WHERE is_excluded = 1 OR {HASH} < {int(0.025 * 2**32)}")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(provider_labels(spark, d), "npi", 0.025, keep="is_excluded")


@query(f"WITH {LABELS} SELECT * FROM providers WHERE {HASH} < {int(0.1 * 2**32)}")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(provider_labels(spark, d), "npi", 0.1)


@query(f"WITH {LABELS}, {RANKED} SELECT npi, is_excluded FROM ranked WHERE is_excluded = 1 OR rn <= floor(stratum_n * 0.1::DOUBLE + 0.5)")
def provider_sample_exact(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exact_negatives(provider_labels(spark, d), "npi", "is_excluded", 0.1)


@query(f"WITH {LABELS}, {RANKED} SELECT npi, is_excluded, CASE WHEN rn <= floor(stratum_n * 0.2::DOUBLE + 0.5) THEN 1 ELSE 0 END AS is_test FROM ranked")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(provider_labels(spark, d), "npi", "is_excluded")


SPLIT = f"{RANKED}, split AS (SELECT npi, CASE WHEN rn <= floor(stratum_n * 0.2::DOUBLE + 0.5) THEN 1 ELSE 0 END AS is_test FROM ranked)"
#: Orders as payments, of which one in nine has no provider and is a group of its own, below 0.
GROUPED = """rows AS (SELECT record_id, CASE WHEN record_id % 9 = 0 THEN -1 - record_id ELSE o.npi END AS npi, is_excluded FROM (SELECT o_orderkey AS record_id, o_custkey AS npi FROM orders) o JOIN providers p ON o.npi = p.npi),
 groups AS (SELECT npi, max(is_excluded) AS is_excluded FROM rows GROUP BY 1)"""
ROWS = "rows AS (SELECT o_orderkey AS record_id, o_custkey AS npi, is_excluded FROM orders JOIN providers ON o_custkey = npi)"


def _order_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("npi")).join(provider_labels(spark, d), "npi")


@query(f"WITH {LABELS}, {SPLIT}, {ROWS} SELECT record_id, npi, is_excluded, is_test FROM rows JOIN split USING (npi)")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.group_split(_order_rows(spark, d), "npi", "is_excluded").select("record_id", "npi", "is_excluded", "is_test")


@query("SELECT o_orderkey AS record_id, coalesce(CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END, -1 - o_orderkey) AS group_id FROM orders")
def provider_groups(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("npi"))
    return sampling.with_groups(src, "npi", "record_id").select("record_id", "group_id")


FOLDS = f"{RANKED}, folds AS (SELECT npi, is_excluded, ((rn - 1) % 5)::INT AS fold FROM ranked)"


@query(f"WITH {LABELS}, {FOLDS} SELECT * FROM folds")
def stratified_kfold(spark: SparkSession, d: str) -> DataFrame:
    return sampling.folds(provider_labels(spark, d), "npi", "is_excluded")


@query(f"WITH {LABELS}, {FOLDS} SELECT o_orderkey AS record_id, npi, is_excluded, fold FROM orders JOIN folds ON o_custkey = npi")
def group_kfold(spark: SparkSession, d: str) -> DataFrame:
    return sampling.group_folds(_order_rows(spark, d), "npi", "is_excluded").select("record_id", "npi", "is_excluded", "fold")


@query(f"""WITH {LABELS}, {GROUPED}, {SPLIT.replace("FROM providers", "FROM groups")}, per AS (SELECT is_test, npi, count(*) AS n, sum(is_excluded) AS p, max(is_excluded) AS y FROM rows JOIN split USING (npi) GROUP BY ALL)
 SELECT is_test, sum(n)::BIGINT AS n_rows, sum(CASE WHEN npi >= 0 THEN 1 ELSE 0 END)::BIGINT AS n_groups, sum(CASE WHEN npi < 0 THEN n ELSE 0 END)::BIGINT AS rows_without_npi, sum(CASE WHEN npi >= 0 THEN y ELSE 0 END)::BIGINT AS n_positive_groups, sum(p)::BIGINT AS n_positive_rows, {r6("sum(p)::DOUBLE / sum(n)")} AS positive_rate FROM per GROUP BY 1""")
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    src = _order_rows(spark, d).withColumn("npi", F.when(F.col("record_id") % 9 != 0, F.col("npi")))
    rows = sampling.with_groups(src, "npi", "record_id").withColumn("npi", F.col("group_id"))
    return rounded(sampling.split_stats(sampling.group_split(rows, "npi", "is_excluded"), "npi", "is_excluded"), "positive_rate")


@query(f"WITH {LABELS}, {SPLIT} SELECT npi FROM split WHERE is_test = 1 INTERSECT SELECT npi FROM split WHERE is_test = 0")
def split_disjointness(spark: SparkSession, d: str) -> DataFrame:
    split = sampling.group_split(_order_rows(spark, d), "npi", "is_excluded")
    return sampling.overlap(split.where("is_test = 1"), split.where("is_test = 0"), "npi")


# ---------------------------------------------------------------- encodings


@query(f"""WITH {PAY}, m AS (SELECT avg(is_excluded) AS g FROM payments) SELECT coalesce(specialty, 'Missing') AS specialty, {r6("(sum(is_excluded) + max(g) * 50) / (count(*) + 50)")} AS encoded FROM payments, m GROUP BY 1""")
def target_encoding(spark: SparkSession, d: str) -> DataFrame:
    return rounded(encoders.fit_target_encoding(pay(spark, d), "specialty", "is_excluded")[0], "encoded")


def _oof_sql(fold_of: str) -> str:
    return f"""cells AS (SELECT coalesce(specialty, 'Missing') AS specialty, {fold_of} AS fold, sum(is_excluded)::DOUBLE AS s, count(*) AS n FROM src GROUP BY ALL),
 f AS (SELECT fold, ((SELECT sum(s) FROM cells) - sum(s)) / nullif((SELECT sum(n) FROM cells) - sum(n), 0) AS g FROM cells GROUP BY fold),
 c AS (SELECT specialty, sum(s) AS ts, sum(n) AS tn FROM cells GROUP BY 1)
 SELECT specialty, fold, n, {r6("(ts - s + coalesce(g, 0) * 50) / (tn - n + 50)")} AS encoded FROM cells JOIN c USING (specialty) JOIN f USING (fold)"""


def _oof(src: DataFrame, fold: str) -> DataFrame:
    out = encoders.out_of_fold(src, "specialty", "is_excluded", fold, "encoded")
    return rounded(out.groupBy(X.missing(F.col("specialty")).alias("specialty"), F.col(fold).alias("fold")).agg(F.count("*").alias("n"), F.max("encoded").alias("encoded")), "encoded")


@query(f"WITH {PAY}, src AS (SELECT * FROM payments), {_oof_sql('(record_id % 5)::INT')}")
def oof_target_encoding(spark: SparkSession, d: str) -> DataFrame:
    return _oof(pay(spark, d).withColumn("fold", (F.col("record_id") % 5).cast("int")), "fold")


@query(f"WITH {PAY}, {LABELS}, {FOLDS}, src AS (SELECT payments.*, fold FROM payments JOIN folds USING (npi)), {_oof_sql('fold')}")
def oof_group_target_encoding(spark: SparkSession, d: str) -> DataFrame:
    folds = sampling.folds(provider_labels(spark, d), "npi", "is_excluded").select("npi", "fold")
    return _oof(pay(spark, d).join(folds, "npi"), "fold")


@query(f"WITH {PAY} SELECT coalesce(specialty, 'Missing') AS specialty, count(*) AS n, {r6('count(*)::DOUBLE / (SELECT count(*) FROM payments)')} AS share FROM payments GROUP BY 1")
def frequency_encoding(spark: SparkSession, d: str) -> DataFrame:
    return rounded(encoders.frequency_encoding(pay(spark, d), "specialty"), "share")


@query(f"""WITH {PAY}, kept AS (SELECT form FROM payments WHERE form <> '5-LOW' AND form IS NOT NULL GROUP BY 1 HAVING count(*) >= 1000),
 b AS (SELECT record_id, CASE WHEN form IN (SELECT form FROM kept) AND form <> '5-LOW' THEN form ELSE 'Other' END AS v FROM payments)
 SELECT v AS bucket, count(*) AS n, sum(CASE WHEN v = '2-HIGH' THEN 1 ELSE 0 END)::BIGINT AS n_high FROM b GROUP BY 1""")
def rare_bucket_onehot(spark: SparkSession, d: str) -> DataFrame:
    src = pay(spark, d).withColumn("form", F.nullif(F.col("form"), F.lit("5-LOW")))
    kept = sorted(r[0] for r in encoders.kept_categories(src, "form").collect())
    hot = encoders.one_hot(src, "form", kept, "form_")
    names = [c for c in hot.columns if c.startswith("form_")]
    bucket = F.coalesce(*(F.when(F.col(c) == 1, F.lit(v)) for c, v in zip(names, [*kept, encoders.OTHER], strict=True)))
    high = F.col("form_2_HIGH") if "form_2_HIGH" in names else F.lit(0)
    return hot.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(high).cast("long").alias("n_high"))


@query("""WITH src AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)
 SELECT event_id, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS value_missing, coalesce(value, (SELECT median(value) FROM src WHERE event_id % 5 <> 0)) AS value FROM src""")
def impute_missing_flag(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return encoders.impute(src, "value", encoders.fit_median(src.where("event_id % 5 <> 0"), "value"))


@query(f"""WITH {PAY}, {LABELS}, {FOLDS}, pairs AS (SELECT npi, manufacturer::VARCHAR AS m, count(*) AS pc, sum(amount::DECIMAL(18,2))::DOUBLE AS amount FROM payments GROUP BY ALL),
 src AS (SELECT pairs.*, fold, is_excluded * pc AS y FROM pairs JOIN folds USING (npi)), cells AS (SELECT m, fold, sum(y)::DOUBLE AS s, sum(pc) AS n FROM src GROUP BY ALL),
 f AS (SELECT fold, ((SELECT sum(s) FROM cells) - sum(s)) / ((SELECT sum(n) FROM cells) - sum(n)) AS g FROM cells GROUP BY 1), c AS (SELECT m, sum(s) AS ts, sum(n) AS tn FROM cells GROUP BY 1),
 e AS (SELECT npi, amount, (ts - s + g * 50) / (tn - n + 50) AS enc FROM src JOIN cells USING (m, fold) JOIN c USING (m) JOIN f USING (fold))
 SELECT npi, {r6("CASE WHEN sum(amount) > 0 THEN sum(enc * amount) / sum(amount) ELSE avg(enc) END")} AS risk FROM e GROUP BY npi""")
def manufacturer_weighted_risk(spark: SparkSession, d: str) -> DataFrame:
    folds = sampling.folds(provider_labels(spark, d), "npi", "is_excluded")
    return rounded(encoders.manufacturer_risk(providers.manufacturer_pairs(pay(spark, d)), folds), "risk")


# ---------------------------------------------------------------- metrics

GROUPS = "per AS (SELECT score, sum(is_excluded) AS pos, count(*) AS n FROM scored GROUP BY 1), g AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER () AS p, sum(n) OVER () AS t FROM per WINDOW w AS (ORDER BY score DESC))"
AP = "sum((pos::DOUBLE / nullif(p, 0)) * (cp::DOUBLE / cn))"
AUC = "sum(pos * (t - p - (cn - cp) + (n - pos) / 2.0::DOUBLE)) / nullif(max(p * (t - p)), 0)"
PRF = "coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"


@query(f"""WITH {SCORED}, c AS (SELECT sum(CASE WHEN score < 0.35 AND is_excluded = 0 THEN 1 ELSE 0 END)::BIGINT AS tn, sum(CASE WHEN score >= 0.35 AND is_excluded = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
 sum(CASE WHEN score < 0.35 AND is_excluded = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN score >= 0.35 AND is_excluded = 1 THEN 1 ELSE 0 END)::BIGINT AS tp FROM scored) SELECT *, {PRF} FROM c""")
def confusion_and_prf(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(scored(spark, d), "score", "is_excluded", 0.35)


@query(f"WITH {SCORED}, {GROUPS} SELECT {r6(AP)} AS average_precision FROM g")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.average_precision(metrics.score_groups(scored(spark, d), "score", "is_excluded")), "average_precision")


@query(f"WITH {SCORED}, {GROUPS} SELECT {r6(AUC)} AS roc_auc FROM g")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc_auc(metrics.score_groups(scored(spark, d), "score", "is_excluded")), "roc_auc")


@query(f"WITH {SCORED}, {GROUPS} SELECT {r6('score')} AS score, {r6('cp::DOUBLE / cn')} AS precision, {r6('cp::DOUBLE / nullif(p, 0)')} AS recall FROM g")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.pr_curve(metrics.score_groups(scored(spark, d), "score", "is_excluded")), "score", "precision", "recall")


SWEEP = f"""grid AS (SELECT k::DOUBLE / 1000 AS threshold FROM range(0, 1001) t(k)), s AS (SELECT threshold, sum(CASE WHEN score >= threshold THEN is_excluded ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN score >= threshold THEN 1 - is_excluded ELSE 0 END)::BIGINT AS fp,
 sum(CASE WHEN score < threshold THEN is_excluded ELSE 0 END)::BIGINT AS fn FROM grid, scored GROUP BY threshold), sweep AS (SELECT *, {PRF} FROM s)"""


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    return metrics.threshold_sweep(scored(spark, d), "score", "is_excluded")


@query(f"WITH {SCORED}, {SWEEP} SELECT threshold, tp, fp, fn, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM sweep")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sweep(spark, d), "precision", "recall", "f1")


_PICK = "(SELECT '{n}' AS selection, threshold, " + ", ".join(f"{r6(c)} AS {c}" for c in ("precision", "recall", "f1")) + " FROM sweep WHERE {w} ORDER BY sweep.{c} DESC, threshold LIMIT 1)"


@query(f"WITH {SCORED}, {SWEEP} " + " UNION ALL ".join(_PICK.format(n=n, w=w, c=c) for n, w, c in (("best_f1", "true", "f1"), ("best_precision", "sweep.recall >= 0.8", "precision"), ("best_recall", "sweep.precision >= 0.1", "recall"))))
def threshold_selection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.selections(_sweep(spark, d), 0.8, 0.1), "precision", "recall", "f1")


@query(f"WITH {SCORED}, {SWEEP} SELECT threshold, tp, fp, fn FROM sweep ORDER BY abs(threshold - 0.3337), threshold LIMIT 1")
def nearest_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_threshold(_sweep(spark, d), 0.3337).select("threshold", "tp", "fp", "fn")


FEATURES = ["total_payment_count", "share_related", "share_third_party", "n_manufacturers"]
FEATURE_SQL = PAY + ", f AS (SELECT npi, max(is_excluded) AS is_excluded, count(*)::DOUBLE AS total_payment_count, sum(related)::DOUBLE / count(*) AS share_related, sum(third_party)::DOUBLE / count(*) AS share_third_party, count(DISTINCT manufacturer)::DOUBLE AS n_manufacturers FROM payments GROUP BY npi)"


def provider_numbers(spark: SparkSession, d: str) -> DataFrame:
    return pay(spark, d).groupBy("npi").agg(F.max("is_excluded").alias("is_excluded"), F.count("*").cast("double").alias("total_payment_count"), X.divide(F.sum("related"), F.count("*")).alias("share_related"), X.divide(F.sum("third_party"), F.count("*")).alias("share_third_party"), F.count_distinct("manufacturer").cast("double").alias("n_manufacturers"))


@query(f"""WITH {FEATURE_SQL}, l AS (UNPIVOT f ON {", ".join(FEATURES)} INTO NAME feature VALUE score), per AS (SELECT feature, score, sum(is_excluded) AS pos, count(*) AS n FROM l GROUP BY ALL),
 g AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER a AS p, sum(n) OVER a AS t FROM per WINDOW w AS (PARTITION BY feature ORDER BY score DESC), a AS (PARTITION BY feature))
 SELECT feature, {r6(AP)} AS average_precision, {r6(AUC)} AS roc_auc, {r6("max(p)::DOUBLE / max(t)")} AS positive_rate, {r6(f"{AP} / (max(p)::DOUBLE / max(t))")} AS lift FROM g GROUP BY feature""")
def single_feature_baselines(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.single_feature_baselines(provider_numbers(spark, d), [*FEATURES, "absent"], "is_excluded")
    return rounded(out, "average_precision", "roc_auc", "positive_rate", "lift")


_SIDES = "per AS (SELECT side, score, sum(is_excluded) AS pos, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER a AS p FROM per WINDOW w AS (PARTITION BY side ORDER BY score DESC), a AS (PARTITION BY side))"


@query(f"""WITH {SCORED}, s AS (SELECT npi % 2 AS side, score, is_excluded FROM scored), {_SIDES}, ap AS (SELECT side, {AP} AS ap FROM g GROUP BY 1)
 SELECT {r6("max(CASE WHEN side = 0 THEN ap END)")} AS train_ap, {r6("max(CASE WHEN side = 1 THEN ap END)")} AS test_ap, {r6("max(CASE WHEN side = 0 THEN ap END) / max(CASE WHEN side = 1 THEN ap END)")} AS ap_ratio FROM ap""")
def memorization_gap(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return rounded(metrics.memorization_gap(s.where("npi % 2 = 0"), s.where("npi % 2 = 1"), "score", "is_excluded"), "train_ap", "test_ap", "ap_ratio")


@query(f"""WITH {SCORED}, r AS (SELECT *, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100 AS pr FROM scored),
 q AS (SELECT quantile_cont(score, 0.99) AS q1, quantile_cont(score, 0.95) AS q5, quantile_cont(score, 0.9) AS q10 FROM scored)
 SELECT sum(is_excluded)::BIGINT AS n_positive, {r6("avg(CASE WHEN is_excluded = 1 THEN score END)")} AS mean_score_positive, {r6("avg(CASE WHEN is_excluded = 0 THEN score END)")} AS mean_score_negative,
 {r6("avg(CASE WHEN is_excluded = 1 THEN pr END)")} AS mean_rank_positive, {r6("avg(CASE WHEN is_excluded = 0 THEN pr END)")} AS mean_rank_negative,
 {", ".join(f"sum(CASE WHEN score >= q{k} THEN is_excluded ELSE 0 END)::BIGINT AS top_{k}_captured, {r6(f'sum(CASE WHEN score >= q{k} THEN is_excluded ELSE 0 END)::DOUBLE / nullif(sum(is_excluded), 0)')} AS top_{k}_capture_rate" for k in (1, 5, 10))} FROM r, q""")
def anomaly_capture(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.anomaly_capture(scored(spark, d), "score", "is_excluded"), *(f"top_{k}_capture_rate" for k in (1, 5, 10)), "mean_score_positive", "mean_score_negative", "mean_rank_positive", "mean_rank_negative")


@query("SELECT count(*) AS n, sum(CASE WHEN a.v IS NULL OR b.v IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_unmatched, max(abs(a.v - b.v)) AS max_difference FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 10 <> 1) a FULL JOIN (SELECT c_custkey AS k, c_acctbal + 0.5 AS v FROM customer WHERE c_custkey % 10 <> 2) b USING (k)")
def reproduction_check(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return metrics.reproduction_gap(c.where("k % 10 <> 1"), c.where("k % 10 <> 2").withColumn("v", F.col("v") + 0.5), "k", "v")


# ---------------------------------------------------------------- statistics

SMR = """cells AS (SELECT manufacturer::VARCHAR AS grp, coalesce(specialty, 'Missing') AS st, count(*) AS n, sum(is_excluded) AS pos FROM payments GROUP BY ALL), rate AS (SELECT st, sum(pos)::DOUBLE / sum(n) AS rate FROM cells GROUP BY 1),
 smr AS (SELECT grp, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS observed, sum(n * rate) AS expected FROM cells JOIN rate USING (st) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)"""


@query(f"WITH {PAY}, {SMR} SELECT grp, n, observed, {r6('expected')} AS expected, {r6('observed / nullif(expected, 0)')} AS smr FROM smr")
def smr_by_manufacturer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.standardized_rates(pay(spark, d), "manufacturer", "specialty", "is_excluded"), "expected", "smr")


@query()
def smr_intervals(spark: SparkSession, d: str) -> DataFrame:
    return stats.smr_intervals(stats.standardized_rates(pay(spark, d), "manufacturer", "specialty", "is_excluded"))


_W = "(p + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)"


@query(f"""WITH {PAY}, g AS (SELECT avg(is_excluded) AS g FROM payments), c AS (SELECT coalesce(specialty, 'Missing') AS category, count(*)::DOUBLE AS n, sum(is_excluded)::BIGINT AS n_positive, sum(is_excluded)::DOUBLE / count(*) AS p FROM payments GROUP BY 1),
 w AS (SELECT category, n, n_positive, p, {_W.format(s="-")} AS low, {_W.format(s="+")} AS high FROM c)
 SELECT category, n::BIGINT AS n, n_positive, {r6("p")} AS rate, {r6("low")} AS low, {r6("high")} AS high, CASE WHEN low > g THEN 'ABOVE' WHEN high < g THEN 'below' ELSE '~same' END AS verdict FROM w, g""")
def wilson_rates(spark: SparkSession, d: str) -> DataFrame:
    p = pay(spark, d)
    overall = p.agg(F.avg("is_excluded")).first()[0] or 0.0
    rates = eda.category_rates(p, X.missing(F.col("specialty")), "is_excluded")
    return rounded(eda.wilson_rates(rates, F.lit(overall)), "rate", "low", "high")


@query(f"""WITH {PAY}, r AS (SELECT npi, count(*) AS n, sum(is_excluded)::BIGINT AS k, sum(related)::DOUBLE AS pos, sum(related)::DOUBLE / count(*) AS rate FROM payments GROUP BY 1),
 b AS (SELECT *, CASE WHEN n < 20 THEN 0 WHEN n < 40 THEN 1 WHEN n < 60 THEN 2 ELSE 3 END AS band FROM r), q AS (SELECT band, sum(pos) / sum(n) AS p FROM b GROUP BY 1),
 o AS (SELECT band, count(*) AS n_categories, max(p) AS p, var_pop(rate) AS vo, avg(p * (1 - p) / n) AS vc FROM b JOIN q USING (band) GROUP BY 1)
 SELECT band, n_categories, {r6("p")} AS pooled_rate, {r6("vo")} AS var_observed, {r6("vc")} AS var_chance, {r6("greatest(vo - vc, 0) / nullif(vo, 0)")} AS excess_share FROM o""")
def size_band_excess_variance(spark: SparkSession, d: str) -> DataFrame:
    rates = eda.category_rates(pay(spark, d), F.col("npi"), "related")
    return rounded(eda.size_bands(rates, (20, 40, 60)), "pooled_rate", "var_observed", "var_chance", "excess_share")


@query(f"""WITH {PAY}, c AS (SELECT npi, count(*) AS n FROM payments GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY n DESC, npi ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS t FROM c)
 SELECT count(*) AS n_categories, sum(CASE WHEN before < t * 0.9 THEN 1 ELSE 0 END)::BIGINT AS n_to_share, median(n)::DOUBLE AS median_rows, sum(CASE WHEN n < 100 THEN 1 ELSE 0 END)::BIGINT AS n_small, {r6("sum(CASE WHEN n < 100 THEN n ELSE 0 END)::DOUBLE / max(t)")} AS small_share FROM s""")
def volume_concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.concentration(pay(spark, d), "npi"), "small_share")


CV = "cv AS (SELECT l_linenumber AS max_depth, l_quantity::INT % 3 AS n_rounds, l_orderkey % 5 AS fold, avg(l_discount) AS score FROM lineitem GROUP BY ALL)"


def _cv(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.groupBy(F.col("l_linenumber").alias("max_depth"), (F.col("l_quantity").cast("int") % 3).alias("n_rounds"), (F.col("l_orderkey") % 5).alias("fold")).agg(F.avg("l_discount").alias("score"))


@query(f"WITH {CV} SELECT max_depth, n_rounds, {r6('avg(score)')} AS mean, {r6('stddev_samp(score)')} AS std, count(*) AS n_folds FROM cv GROUP BY ALL")
def cv_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.cv_summary(_cv(spark, d), ["max_depth", "n_rounds"], "score"), "mean", "std")


@query(f"WITH {CV}, s AS (SELECT max_depth, n_rounds, avg(score) AS mean, stddev_samp(score) AS std, count(*) AS n_folds FROM cv GROUP BY ALL), b AS (SELECT mean - std AS f FROM s ORDER BY mean DESC LIMIT 1) SELECT max_depth, n_rounds, {r6('mean')} AS mean, {r6('std')} AS std, n_folds FROM s, b WHERE mean >= f ORDER BY max_depth, n_rounds LIMIT 1")
def one_sd_selection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.one_sd_choice(stats.cv_summary(_cv(spark, d), ["max_depth", "n_rounds"], "score"), ["max_depth", "n_rounds"]), "mean", "std")


@query(f"WITH {CV} SELECT 'max_depth' AS axis, max_depth::BIGINT AS value, {r6('avg(score)')} AS mean FROM cv GROUP BY 2 UNION ALL SELECT 'n_rounds', n_rounds, {r6('avg(score)')} FROM cv GROUP BY 2")
def marginal_means(spark: SparkSession, d: str) -> DataFrame:
    src = _cv(spark, d).withColumns({c: F.col(c).cast("long") for c in ("max_depth", "n_rounds")})
    return rounded(stats.marginal_means(src, ["max_depth", "n_rounds"], "score"), "mean")


@query(f"WITH {CV} SELECT n_rounds, {', '.join(f'{r6(f'{f}(score)')} AS {n}_score' for n, f in (('mean', 'avg'), ('min', 'min'), ('max', 'max')))} FROM cv GROUP BY 1")
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.seed_summary(_cv(spark, d), "n_rounds", ["score"]), "mean_score", "min_score", "max_score")


@query(f"WITH {CV}, e AS (SELECT a.score - b.score AS d FROM cv a JOIN cv b ON a.fold = b.fold AND a.max_depth = b.max_depth WHERE a.n_rounds = 0 AND b.n_rounds = 1) SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END)::BIGINT AS wins, {r6('avg(d)')} AS mean_difference, {r6('stddev_samp(d)')} AS std_difference FROM e")
def paired_differences(spark: SparkSession, d: str) -> DataFrame:
    src = _cv(spark, d).withColumn("key", F.concat_ws("-", "fold", "max_depth")).withColumn("variant", F.col("n_rounds").cast("string"))
    return rounded(stats.paired_wins(src, "key", "variant", "score", "0", "1"), "mean_difference", "std_difference")


@query("SELECT a.v AS max_depth, b.v AS min_child_weight, c.v AS reg_lambda, e.v AS n_estimators FROM (VALUES (1), (2), (3)) a(v), (VALUES (50), (100), (200)) b(v), (VALUES (1), (10), (50)) c(v), (VALUES (100), (150), (300)) e(v)")
def grid_cross_product(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([tuple(c.values()) for c in models.grid_configs()], "max_depth int, min_child_weight int, reg_lambda int, n_estimators int")


# ---------------------------------------------------------------- EDA

GAPS = "src AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, event_type FROM events)"


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"), "event_type")


@query(f"WITH {GAPS} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null, {r6(f'sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::DOUBLE * 100 / count(*)')} AS pct_null FROM src" for c in ("event_id", "value", "user_id")))
def missingness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.missingness(_gaps(spark, d), ["event_id", "value", "user_id"]), "pct_null")


@query(f"WITH {GAPS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, event_type, count({c}) AS n, {r6(f'avg({c})')} AS mean, {r6(f'stddev_pop({c})')} AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM src WHERE {c} IS NOT NULL GROUP BY 2" for c in ("value", "user_id")))
def numeric_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.moments(_gaps(spark, d), ["value", "user_id"], "event_type"), "mean", "std")


@query("SELECT event_type, " + ", ".join(f"{r6(f'quantile_cont(value, {p})')} AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM events GROUP BY 1")
def class_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.percentiles(table(spark, d, "events"), "value", "event_type"), "p25", "p50", "p75", "p95", "p99")


@query(f"WITH {PAY} SELECT specialty AS category, count(*) AS n, sum(is_excluded)::BIGINT AS n_positive, {r6('sum(is_excluded)::DOUBLE / count(*)')} AS rate FROM payments WHERE specialty IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def category_exclusion_rates(spark: SparkSession, d: str) -> DataFrame:
    rates = eda.category_rates(pay(spark, d).where("specialty is not null"), F.col("specialty"), "is_excluded")
    return rounded(eda.top(rates, 15, F.col("n").desc(), "category"), "rate")


@query(f"""SELECT sum((1 - a) * (1 - b))::BIGINT AS neither, sum(a * (1 - b))::BIGINT AS only_a, sum((1 - a) * b)::BIGINT AS only_b, sum(a * b)::BIGINT AS both, {r6("sum(a * b)::DOUBLE * 100 / nullif(sum(a), 0)")} AS pct_of_a, {r6("sum(a * b)::DOUBLE * 100 / nullif(sum(b), 0)")} AS pct_of_b
 FROM (SELECT CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS a, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS b FROM customer)""")
def label_crosstab(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "customer").select((F.col("c_acctbal") < 0).cast("int").alias("a"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("b"))
    return rounded(eda.crosstab(src, "a", "b"), "pct_of_a", "pct_of_b")


def _flag_sql(f: str) -> str:
    a, b = (f"sum(CASE WHEN is_excluded = {y} THEN {f} END)::DOUBLE / nullif(sum(CASE WHEN is_excluded = {y} THEN 1 ELSE 0 END), 0)" for y in (1, 0))
    return f"SELECT '{f}' AS flag, {r6(a)} AS rate_positive, {r6(b)} AS rate_negative, coalesce({r6(f'({a}) / nullif({b}, 0)')}, 'infinity'::DOUBLE) AS lift FROM payments"


@query(f"WITH {PAY} {_flag_sql('related')} UNION ALL {_flag_sql('third_party')}")
def flag_lift(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(eda.flag_lift(pay(spark, d), ["related", "third_party"], "is_excluded"), "rate_positive", "rate_negative")
    return out.withColumn("lift", F.when(F.col("lift") < float("inf"), X.r6(F.col("lift"))).otherwise(F.col("lift")))


_COR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS r FROM lineitem" for i, a in enumerate(_COR) for b in _COR[i + 1 :]))
def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.correlations(table(spark, d, "lineitem"), _COR), "r")


@query(f"SELECT a, b, {r6('r')} AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(_COR) for b in _COR[i + 1 :]) + ") WHERE abs(r) >= 0.5")
def strong_correlations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.strong(eda.correlations(table(spark, d, "lineitem"), _COR)), "r")


@query(f"WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem) SELECT {r6('corr(a, b)')} AS rho FROM r")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "rho")


@query(f"""WITH r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 50 AS w, max(o_totalprice) AS hi FROM orders), s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS flag, CASE WHEN o_totalprice = hi THEN 49 ELSE floor((o_totalprice - lo) / w) END::BIGINT AS bin, w FROM orders, r),
 c AS (SELECT flag, bin, count(*) AS n, max(w) AS w FROM s GROUP BY ALL) SELECT flag, bin, n, {r6("n / (sum(n) OVER (PARTITION BY flag) * w) * 1e6")} AS density FROM c""")
def numeric_histogram(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("flag"))
    return rounded(eda.density(src, "o_totalprice", "flag", 50).withColumn("density", F.col("density") * 1e6), "density")


#: The 20 largest specialties with Wilson's interval of their rates.
LARGEST = """al AS (SELECT specialty AS category, count(*) AS n, sum(is_excluded) AS p FROM payments WHERE specialty IS NOT NULL GROUP BY 1), tot AS (SELECT sum(n)::DOUBLE AS tn, sum(p)::DOUBLE AS tp FROM al),
 r AS (SELECT *, p::DOUBLE / n AS rate, 1.96::DOUBLE AS z FROM (SELECT * FROM al ORDER BY n DESC, category LIMIT 20), tot),
 w AS (SELECT *, (rate + z * z / (2 * n) - z * sqrt((rate * (1 - rate) + z * z / (4 * n)) / n)) / (1 + z * z / n) AS low, (rate + z * z / (2 * n) + z * sqrt((rate * (1 - rate) + z * z / (4 * n)) / n)) / (1 + z * z / n) AS high FROM r)"""


@query(f"""WITH {PAY}, {LARGEST} SELECT {r6('min(rate)')} AS min_rate, {r6('max(rate)')} AS max_rate, {r6('max(CASE WHEN rate > 0 THEN rate END) / min(CASE WHEN rate > 0 THEN rate END)')} AS max_min_ratio, {r6('quantile_cont(rate, 0.75) / nullif(quantile_cont(rate, 0.25), 0)')} AS quartile_ratio, sum(p)::BIGINT AS n_positive,
 sum(CASE WHEN low > tp / tn THEN 1 ELSE 0 END)::BIGINT AS n_above, sum(CASE WHEN high < tp / tn AND NOT low > tp / tn THEN 1 ELSE 0 END)::BIGINT AS n_below, sum(CASE WHEN low > tp / tn OR high < tp / tn THEN 0 ELSE 1 END)::BIGINT AS n_same, {r6('sum(p) / max(tp)')} AS share_of_positives FROM w""")
def rate_spread(spark: SparkSession, d: str) -> DataFrame:
    rates = eda.category_rates(pay(spark, d).where("specialty is not null"), F.col("specialty"), "is_excluded")
    return rounded(eda.spread(rates), "min_rate", "max_rate", "max_min_ratio", "quartile_ratio", "share_of_positives")


@query(f"WITH {PAY} SELECT substr(coalesce(specialty, 'Missing'), 1, 7) AS label, count(*) AS n, {r6('avg(is_excluded)')} AS rate, CASE WHEN coalesce(specialty, 'Missing') IN ('Brand#1', 'Missing') THEN 1 ELSE 0 END AS highlighted FROM payments GROUP BY coalesce(specialty, 'Missing')")
def rate_bars(spark: SparkSession, d: str) -> DataFrame:
    rates = eda.category_rates(pay(spark, d), X.missing(F.col("specialty")), "is_excluded")
    return rounded(eda.ordered_bars(rates, ["Brand#1", "Missing"], 7), "rate")


NATURE_SHARES = ", ".join(r6(f"avg(CASE WHEN nature = '{n}' THEN 1 ELSE 0 END)") + f" AS share_nature_{n}" for n in NATURES[:2])


@query(f"WITH {PAY} SELECT npi, {NATURE_SHARES}, {r6('avg(CASE WHEN nature IN (' + repr(NATURES[0]) + ', ' + repr(NATURES[1]) + ') THEN 0 ELSE 1 END)')} AS share_nature_other FROM payments GROUP BY npi")
def provider_nature_mix_other(spark: SparkSession, d: str) -> DataFrame:
    return rounded(providers.nature_mix(pay(spark, d), NATURES[:2], "other"), *(f"share_nature_{n}" for n in [*NATURES[:2], "other"]))


@query(f"WITH {PAY} SELECT CASE nature WHEN 'AF' THEN 'accepted' WHEN 'RF' THEN 'returned' ELSE 'other' END AS nature_group, count(*) AS n FROM payments GROUP BY 1")
def nature_groups(spark: SparkSession, d: str) -> DataFrame:
    return pay(spark, d).groupBy(X.remap(F.col("nature"), {"AF": "accepted", "RF": "returned"}).alias("nature_group")).agg(F.count("*").alias("n"))


@query(f"WITH {PAY} SELECT npi, manufacturer, count(DISTINCT form) AS n_values FROM payments GROUP BY ALL HAVING count(DISTINCT form) > 1")
def encoded_value_varies(spark: SparkSession, d: str) -> DataFrame:
    return providers.varying(pay(spark, d), ["npi", "manufacturer"], "form")


@query(f"""WITH s AS (SELECT ln(1 + o_totalprice) AS v, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS flag FROM orders), r AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 30 AS w FROM s),
 b AS (SELECT flag, CASE WHEN v = hi THEN 29 ELSE floor((v - lo) / w) END::BIGINT AS bin, w FROM s, r), c AS (SELECT flag, bin, count(*) AS n, max(w) AS w FROM b GROUP BY ALL) SELECT flag, bin, n, {r6("n / (sum(n) OVER (PARTITION BY flag) * w)")} AS density FROM c""")
def log_histogram(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("flag"))
    return rounded(eda.density(src, "o_totalprice", "flag", 30, log=True), "density")


@query("""WITH src AS (SELECT event_id, event_type, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 11 END AS band, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events), n AS (SELECT count(*) AS n, median(value) AS m FROM src),
 f AS (SELECT coalesce(band::VARCHAR, 'Missing') AS c, count(*) AS k FROM src GROUP BY 1), kept AS (SELECT event_type FROM src GROUP BY 1 HAVING count(*) >= 100)
 SELECT event_id, coalesce(value, m)::FLOAT AS value, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS value_missing, (k::DOUBLE / n)::FLOAT AS band_freq, CASE WHEN event_type IN (SELECT event_type FROM kept) THEN 0 ELSE 1 END AS event_type_Other FROM src JOIN f ON coalesce(band::VARCHAR, 'Missing') = c, n""")
def unsupervised_features(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 11).cast("string").alias("band"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    made = encoders.UnsupervisedPreprocessor([], "value", ["band"], ["event_type"], 100).fit(src)
    return made.transform(src, "event_id").select("event_id", "value", "value_missing", "band_freq", "event_type_Other")


@query(f"WITH {PAY} SELECT count(DISTINCT manufacturer) AS n_a, count(DISTINCT specialty) AS n_b, {r6('count(DISTINCT manufacturer)::DOUBLE / count(DISTINCT specialty)')} AS ratio FROM payments")
def cardinality_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.cardinality_ratio(pay(spark, d), "manufacturer", "specialty"), "ratio")


@query(f"WITH {PAY}, c AS (SELECT nature AS category, count(*) AS n, sum(is_excluded)::BIGINT AS n_positive FROM payments GROUP BY 1) SELECT category, n, n_positive, {r6('0.8::DOUBLE * (n_positive + 0.025::DOUBLE * (n - n_positive))')} AS train_rows FROM c")
def estimated_train_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.estimated_train_rows(eda.category_rates(pay(spark, d), F.col("nature"), "is_excluded")).drop("rate"), "train_rows")


# ---------------------------------------------------------------- dashboard

FLAGGED = PAY + ", flagged AS (SELECT *, ln(1 + amount) AS amount_log, CASE WHEN amount > 60000 THEN 1 ELSE 0 END AS flagged FROM payments)"


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return pay(spark, d).withColumn("amount_log", X.log_amount(F.col("amount"))).withColumn("flagged", (F.col("amount") > 60000).cast("int"))


@query(f"WITH {FLAGGED} SELECT count(*) AS n_payments, sum(flagged)::BIGINT AS n_flagged, sum(is_excluded)::BIGINT AS n_excluded, {r6('sum(flagged)::DOUBLE / count(*)')} AS flagged_rate, {r6('sum(is_excluded)::DOUBLE / count(*)')} AS excluded_rate, {r6('sum(flagged * is_excluded)::DOUBLE / nullif(sum(is_excluded), 0)')} AS recall FROM flagged")
def dashboard_overall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dashboard.overall(_flagged(spark, d), "flagged", "is_excluded"), "flagged_rate", "excluded_rate", "recall")


@query(f"WITH {FLAGGED}, s AS (SELECT 'specialty' AS kind, coalesce(specialty, 'Missing') AS category, flagged FROM flagged UNION ALL SELECT 'manufacturer', manufacturer::VARCHAR, flagged FROM flagged UNION ALL SELECT 'nature', nature, flagged FROM flagged), c AS (SELECT kind, category, count(*) AS n, sum(flagged)::BIGINT AS n_positive, {r6('sum(flagged)::DOUBLE / count(*)')} AS rate FROM s GROUP BY ALL) SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, category) AS rn FROM c) WHERE rn <= 20")
def dashboard_top_categories(spark: SparkSession, d: str) -> DataFrame:
    src, out = _flagged(spark, d), None
    for kind in ("specialty", "manufacturer", "nature"):
        own = dashboard.top_categories(src, F.col(kind), "flagged").withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return rounded(out, "rate")


@query(f"WITH {FLAGGED}, s AS (SELECT CASE WHEN amount_log = 20 THEN 39 ELSE floor(amount_log / 0.5) END::BIGINT AS bin, flagged FROM flagged WHERE amount_log BETWEEN 0 AND 20), c AS (SELECT bin, sum(flagged)::BIGINT AS flagged, sum(1 - flagged)::BIGINT AS other FROM s GROUP BY 1) SELECT b AS bin, b * 0.5::DOUBLE AS edge, coalesce(flagged, 0) AS flagged, coalesce(other, 0) AS other FROM range(0, 40) t(b) LEFT JOIN c ON bin = b")
def dashboard_histogram(spark: SparkSession, d: str) -> DataFrame:
    return eda.histogram(_flagged(spark, d), "amount_log", 0, 20, 40, "flagged")


@query(f"WITH {SCORED} SELECT npi, {r6('score')} AS predicted_probability, CASE WHEN score >= 0.35 THEN 1 ELSE 0 END AS flagged_for_review FROM scored")
def flagged_predictions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dashboard.flagged(scored(spark, d), "score", 0.35, "npi"), "predicted_probability")


# ---------------------------------------------------------------- models (no SQL)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    split = kept(sampling.stratified_split(provider_numbers(spark, d), "npi", "is_excluded"))
    return split.where("is_test = 0"), split.where("is_test = 1")


def _model_scores(spark: SparkSession, d: str, model, balanced: bool = False) -> DataFrame:
    a, b = _sides(spark, d)
    return models.scores(models.train(a, FEATURES, "is_excluded", model, balanced), b, "npi", "is_excluded")


@query()
def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return b.select("npi", "is_excluded", boosting.score(boosting.train(a, FEATURES, "is_excluded", "npi"), FEATURES).alias("score"))


@query()
def rf_scores(spark: SparkSession, d: str) -> DataFrame:
    return _model_scores(spark, d, models.forest("is_excluded", trees=40, depth=8), True)


@query()
def logreg_scores(spark: SparkSession, d: str) -> DataFrame:
    return _model_scores(spark, d, models.logistic("is_excluded"), True)


@query()
def isolation_forest_scores(spark: SparkSession, d: str) -> DataFrame:
    src = provider_numbers(spark, d)
    return isolation_forest.score(src, isolation_forest.fit(src, FEATURES, "npi"), FEATURES, "npi", "is_excluded")


@query()
def bootstrap_auc_diff(spark: SparkSession, d: str) -> DataFrame:
    return stats.paired_bootstrap(provider_numbers(spark, d), "is_excluded", "share_related", "share_third_party")


@query()
def feature_ablation(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return models.ablation(a, b, FEATURES, "is_excluded", "npi", FEATURES, lambda: models.logistic("is_excluded"))


@query()
def hypothetical_score(spark: SparkSession, d: str) -> DataFrame:
    model = models.train(_sides(spark, d)[0], FEATURES, "is_excluded", models.logistic("is_excluded"), True)
    row = spark.range(1).select(F.lit(-1).cast("long").alias("npi"), F.lit(40.0).alias("total_payment_count"), F.lit(0.5).alias("share_related"), F.lit(0.2).alias("share_third_party"), F.lit(20.0).alias("n_manufacturers"))
    return models.scores(model, row, "npi")


def _provider_rows(spark: SparkSession, d: str) -> DataFrame:
    p = pay(spark, d)
    return provider_numbers(spark, d).join(providers.mode(p, "specialty", "specialty").select("npi", "specialty"), "npi")


_BASE = PAY + """, y AS (SELECT npi, max(is_excluded) AS is_excluded FROM payments GROUP BY 1), c AS (SELECT npi, coalesce(specialty, 'Missing') AS s, count(*) AS n FROM payments GROUP BY ALL),
 m AS (SELECT npi, s AS specialty FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY n DESC, s) AS rn FROM c) WHERE rn = 1), providers AS (SELECT npi, is_excluded, specialty FROM y JOIN m USING (npi))"""


@query(f"""WITH {_BASE}, {RANKED}, sides AS (SELECT *, rn <= floor(stratum_n * 0.2::DOUBLE + 0.5) AS is_test FROM ranked), g0 AS (SELECT avg(is_excluded) AS g FROM sides WHERE NOT is_test),
 te AS (SELECT specialty, (sum(is_excluded) + max(g) * 50) / (count(*) + 50) AS e FROM sides, g0 WHERE NOT is_test GROUP BY 1), scored AS (SELECT is_excluded, coalesce(e, g) AS score FROM (SELECT * FROM sides WHERE is_test) LEFT JOIN te USING (specialty), g0), {GROUPS}
 SELECT {r6(AP)} AS average_precision, {r6(AUC)} AS roc_auc, {r6("max(p)::DOUBLE / max(t)")} AS positive_rate, {r6(f"{AP} / (max(p)::DOUBLE / max(t))")} AS lift FROM g""")
def specialty_baseline(spark: SparkSession, d: str) -> DataFrame:
    split = sampling.stratified_split(_provider_rows(spark, d), "npi", "is_excluded")
    return rounded(experiments.specialty_baseline(split.where("is_test = 0"), split.where("is_test = 1")), "average_precision", "roc_auc", "positive_rate", "lift")


@query()
def provider_split_features(spark: SparkSession, d: str) -> DataFrame:
    split = sampling.stratified_split(_provider_rows(spark, d), "npi", "is_excluded")
    a, b = experiments.split_features(split.where("is_test = 0"), split.where("is_test = 1"), providers.manufacturer_pairs(pay(spark, d)), FEATURES)
    return a.withColumn("is_test", F.lit(0)).unionByName(b.withColumn("is_test", F.lit(1)))


@query()
def capacity_variants(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return experiments.capacity(a, b, FEATURES, "is_excluded", "npi")


SPLIT_FEATURES = [*FEATURES, "specialty_te", "manufacturer_weighted_risk"]


def _folds(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    # payments are joined once and dealt by provider, and a provider's numbers are sums over its pairs
    paid = dealt(pay(spark, d).select("npi", "manufacturer", "specialty", "amount", "related", "third_party", "is_excluded"), "npi")
    pairs = paid.groupBy("npi", "manufacturer").agg(F.count("*").alias("payment_count"), X.money(F.col("amount")).alias("amount"), F.sum("related").alias("related"), F.sum("third_party").alias("third_party"), F.max("is_excluded").alias("is_excluded"))
    n = F.sum("payment_count")
    numbers = pairs.groupBy("npi").agg(F.max("is_excluded").alias("is_excluded"), n.cast("double").alias("total_payment_count"), X.divide(F.sum("related"), n).alias("share_related"), X.divide(F.sum("third_party"), n).alias("share_third_party"), F.count("manufacturer").cast("double").alias("n_manufacturers"))
    rows = numbers.join(providers.mode(paid, "specialty", "specialty").select("npi", "specialty"), "npi")
    return experiments.fold_features(rows, pairs.select("npi", "manufacturer", "payment_count", "amount"), FEATURES)


@query()
def fold_features(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for i, sides in enumerate(_folds(spark, d)):
        for held_out, side in enumerate(sides):
            own = side.withColumn("fold", F.lit(i)).withColumn("is_validation", F.lit(held_out))
            out = own if out is None else out.unionByName(own)
    return out


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return boosting.grid_search(spark, _folds(spark, d), models.grid_configs(), SPLIT_FEATURES, "is_excluded", "npi")


@query()
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    r = _grid(spark, d)
    return r.groupBy(*models.GRID).agg(F.avg("average_precision").alias("mean_average_precision"), F.stddev_samp("average_precision").alias("std_average_precision"), F.avg("roc_auc").alias("mean_roc_auc"), F.stddev_samp("roc_auc").alias("std_roc_auc"))


@query()
def cv_separability(spark: SparkSession, d: str) -> DataFrame:
    return experiments.separability(_grid(spark, d), list(models.GRID))


@query()
def split_comparison(spark: SparkSession, d: str) -> DataFrame:
    selected = {"max_depth": 1, "min_child_weight": 50, "reg_lambda": 10, "n_estimators": 150}
    return experiments.compare_on_splits(kept(_provider_rows(spark, d)), kept(providers.manufacturer_pairs(pay(spark, d))), FEATURES, selected)


@query()
def repeated_splits(spark: SparkSession, d: str) -> DataFrame:
    fit = lambda a, b: models.evaluate(models.scores(models.train(a, FEATURES, "is_excluded", models.logistic("is_excluded"), True), b, "npi", "is_excluded"), "is_excluded")
    return experiments.repeated_splits(kept(provider_numbers(spark, d)), "is_excluded", "npi", fit)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
