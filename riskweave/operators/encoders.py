"""Feature encodings that are fitted on training rows and applied elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import exprs as X
from riskweave.functions.ranks import quantiles
from riskweave.operators.providers import weighted_mean
from riskweave.operators.sampling import inner_fold

SMOOTHING, RARE, OTHER = 50.0, 1000, "Other"


def smoothed(total: Column, n: Column, mean: Column, m: float = SMOOTHING) -> Column:
    return (total + mean * m) / (n + m)


def fit_target_encoding(train: DataFrame, category: str, label: str, m: float = SMOOTHING) -> tuple[DataFrame, float]:
    """The smoothed rate of each category (null is Missing), and the overall rate."""
    per = train.groupBy(X.missing(F.col(category)).alias(category)).agg(F.sum(label).cast("double").alias("s"), F.count("*").alias("n"))
    total, rows = train.agg(F.sum(label).cast("double"), F.count("*")).first()
    mean = total / rows if rows else 0.0
    return per.select(category, smoothed(F.col("s"), F.col("n"), F.lit(mean), m).alias("encoded")), mean


def apply_target_encoding(df: DataFrame, mapping: DataFrame, category: str, mean: float, name: str) -> DataFrame:
    """Adds the encoding; categories that training had not get the overall rate."""
    right = mapping.select(F.col(category).alias("_c"), F.col("encoded").alias("_e"))
    return df.join(right, X.missing(F.col(category)) == F.col("_c"), "left").withColumn(name, F.coalesce("_e", F.lit(mean))).drop("_c", "_e")


def out_of_fold(df: DataFrame, category: str, label: str, fold: str, name: str, weight: str | None = None, m: float = SMOOTHING) -> DataFrame:
    """Adds each row's encoding from the other folds only.

    No loop over folds: sums by (category, fold), and a fold's complement is the total less its own. label holds sums
    where weight (rows that a row stands for) is given. Rows without a fold are a fold of their own.
    """
    w = F.col(weight) if weight else F.lit(1)
    cell = df.groupBy(X.missing(F.col(category)).alias("_c"), F.col(fold).alias("_f")).agg(F.sum(label).cast("double").alias("s"), F.sum(w).alias("n"))
    of_category = cell.groupBy("_c").agg(F.sum("s").alias("cs"), F.sum("n").alias("cn"))
    of_fold = cell.groupBy("_f").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    folds = of_fold.withColumn("one", F.lit(1))
    all_of = folds.groupBy("one").agg(F.sum("fs").alias("as"), F.sum("fn").alias("an"))
    rates = folds.join(all_of, "one").select(F.col("_f").alias("_rf"), F.coalesce(X.divide(F.col("as") - F.col("fs"), F.col("an") - F.col("fn")), F.lit(0.0)).alias("g"))
    table = cell.join(of_category, "_c").join(rates, F.col("_f").eqNullSafe(F.col("_rf"))).select("_c", "_f", smoothed(F.col("cs") - F.col("s"), F.col("cn") - F.col("n"), F.col("g"), m).alias(name))
    return df.join(table, (X.missing(F.col(category)) == F.col("_c")) & F.col(fold).eqNullSafe(F.col("_f"))).drop("_c", "_f")


def nested_encodings(cells: DataFrame, category: str, k: int, m: float = SMOOTHING) -> tuple[DataFrame, list[float]]:
    """``_c, encoded array<array<double>>``: of each category for each deal of nested folds and each fold i left out, and the rate without each fold.

    cells: category, deal, s (sum of labels), n (rows), one row or several a deal. A deal of fold i gets the encoding
    of all rows outside of i, any other one that of those of them that are not of its own inner fold.
    """
    deals, inner = range(k * k), lambda i, g: [d for d in range(k * k) if inner_fold(d, i, k) == g]
    found = {r["deal"]: (float(r["s"]), r["n"]) for r in cells.groupBy("deal").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}  # k * k rows
    sums = lambda of: tuple(sum(found.get(d, (0.0, 0))[j] for d in of) for j in (0, 1))
    rate = lambda of: (lambda s, n: s / n if n else 0.0)(*sums(of))
    outside = [[d for d in deals if d % k != i] for i in range(k)]
    per = cells.groupBy(X.missing(F.col(category)).alias("_c")).agg(*(F.sum(F.when(F.col("deal") == d, F.col(c)).otherwise(0)).alias(f"_{c}{d}") for d in deals for c in ("s", "n")))
    added = lambda c, of: sum((F.col(f"_{c}{d}") for d in of[1:]), F.col(f"_{c}{of[0]}")) if of else F.lit(0)
    per = per.withColumns({f"_{c}_{i}": added(c, outside[i]) for i in range(k) for c in ("s", "n")})
    per = per.withColumns({f"_{c}_{i}_{g}": F.col(f"_{c}_{i}") - added(c, inner(i, g)) for i in range(k) for g in range(k) for c in ("s", "n")})

    def encoded(d: int, i: int) -> Column:
        g = inner_fold(d, i, k)
        if g is None:
            all_of = F.lit(rate(outside[i]))
            return F.when(F.col(f"_n_{i}") > 0, smoothed(F.col(f"_s_{i}"), F.col(f"_n_{i}"), all_of, m)).otherwise(all_of)
        return smoothed(F.col(f"_s_{i}_{g}"), F.col(f"_n_{i}_{g}"), F.lit(rate([x for x in outside[i] if inner_fold(x, i, k) != g])), m)

    return per.select("_c", F.array(*(F.array(*(encoded(d, i) for i in range(k))) for d in deals)).alias("encoded")), [rate(x) for x in outside]


def frequency_encoding(df: DataFrame, category: str) -> DataFrame:
    """Each category's share of the rows."""
    per = df.groupBy(X.missing(F.col(category)).alias(category)).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    total = per.groupBy("one").agg(F.sum("n").alias("total"))
    return per.join(total, "one").select(category, "n", X.divide(F.col("n"), F.col("total")).alias("share"))


def kept_categories(train: DataFrame, category: str, least: int = RARE) -> DataFrame:
    """Categories with at least least rows; nulls don't count."""
    return train.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def one_hot(df: DataFrame, category: str, kept: list[str], prefix: str) -> DataFrame:
    """0/1 columns for the kept categories and Other, which takes nulls and the rest."""
    value = F.when(F.col(category).isin(kept), F.col(category)).otherwise(F.lit(OTHER))
    name = lambda v: prefix + "".join(c if c.isalnum() else "_" for c in v)
    return df.select("*", *((value == v).cast("int").alias(name(v)) for v in [*kept, OTHER]))


def fit_median(train: DataFrame, column: str) -> float | None:
    """The exact median, by counts of distinct values: no task sees more than a bucket of them."""
    found = quantiles(train, [], column, [0.5]).first()
    return None if found is None else found["p0"]


def impute(df: DataFrame, column: str, median: float | None) -> DataFrame:
    """The column with nulls as the training median, and a flag where it was null."""
    return df.withColumn(f"{column}_missing", F.col(column).isNull().cast("int")).withColumn(column, F.coalesce(F.col(column), F.lit(median).cast("double")))


def manufacturer_risk(pairs: DataFrame, labels: DataFrame, fold: str = "fold", m: float = SMOOTHING) -> DataFrame:
    """``npi, risk``: the out-of-fold encoding of each of a provider's manufacturers, weighted by the money it paid.

    pairs: npi, manufacturer, payment_count, amount. labels: npi, is_excluded, fold. A payment counts as a row, so
    sums are weighted by payment_count.
    """
    src = pairs.join(labels, "npi").withColumn("y", F.col("is_excluded") * F.col("payment_count")).withColumn("manufacturer", F.col("manufacturer").cast("string"))
    encoded = out_of_fold(src, "manufacturer", "y", fold, "encoded", "payment_count", m)
    return weighted_mean(encoded, "npi", "encoded", "amount", "risk")


class UnsupervisedPreprocessor:
    """Features without any label: numbers as they are, one imputed with its median and flagged, frequency encodings, one-hot columns."""

    def __init__(self, numeric: list[str], imputed: str, frequent: list[str], hot: list[str], rare: int = RARE):
        self.numeric, self.imputed, self.frequent, self.hot, self.rare = numeric, imputed, frequent, hot, rare

    def fit(self, df: DataFrame) -> UnsupervisedPreprocessor:
        self.median = fit_median(df, self.imputed)
        self.shares = {c: frequency_encoding(df, c).select(F.col(c).alias(f"_{c}"), F.col("share").cast("float").alias(f"{c}_freq")) for c in self.frequent}
        self.kept = {c: sorted(r[0] for r in kept_categories(df, c, self.rare).collect()) for c in self.hot}
        return self

    def transform(self, df: DataFrame, *keys: str) -> DataFrame:
        """keys and the features, always the same columns; a category that fit didn't see has a null share."""
        df = impute(df, self.imputed, self.median)
        for c, share in self.shares.items():
            df = df.join(share, X.missing(F.col(c).cast("string")) == F.col(f"_{c}").cast("string"), "left")
        for c in self.hot:
            df = one_hot(df, c, self.kept[c], f"{c}_")
        hot = [n for c in self.hot for n in df.columns if n.startswith(f"{c}_") and n != f"{c}_freq"]
        numbers = [F.col(c).cast("float").alias(c) for c in [*self.numeric, self.imputed]]
        return df.select(*keys, *numbers, f"{self.imputed}_missing", *(f"{c}_freq" for c in self.frequent), *hot)


class Preprocessor:
    """Fitted encodings of payments: an imputed median, target encodings, one-hot columns; always the same columns."""

    def __init__(self, numeric: list[str], targets: list[str], hot: list[str], label: str, rare: int = RARE):
        self.numeric, self.targets, self.hot, self.label, self.rare = numeric, targets, hot, label, rare

    def fit(self, train: DataFrame) -> Preprocessor:
        self.medians = {c: fit_median(train, c) for c in self.numeric}
        self.mappings = {c: fit_target_encoding(train, c, self.label) for c in self.targets}
        self.kept = {c: sorted(r[0] for r in kept_categories(train, c, self.rare).collect()) for c in self.hot}
        return self

    def _rest(self, df: DataFrame) -> DataFrame:
        for c in self.numeric:
            df = impute(df, c, self.medians[c])
        for c in self.hot:
            df = one_hot(df, c, self.kept[c], f"{c}_")
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows that were not trained on: the full training mapping."""
        for c in self.targets:
            df = apply_target_encoding(df, self.mappings[c][0], c, self.mappings[c][1], f"{c}_te")
        return self._rest(df)

    def fit_transform(self, train: DataFrame, fold: str) -> DataFrame:
        """Training rows: each is encoded from the other folds."""
        self.fit(train)
        for c in self.targets:
            train = out_of_fold(train, c, self.label, fold, f"{c}_te")
        return self._rest(train)
