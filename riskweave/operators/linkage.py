"""Linking a large table to a reference list: exact flags, blocked fuzzy matches, key integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import exprs as X

#: Least likeness of each name, its weights, and the least combined score of a match.
COMPONENT, LAST, FIRST, MATCH = 0.50, 0.6, 0.4, 0.65
#: People of a block that one task compares; larger blocks are dealt to several.
BLOCK = 20_000


def exact_flag(payments: DataFrame, listed: DataFrame, key: str, list_key: str, name: str = "is_excluded") -> DataFrame:
    """Adds 1 where a valid key is on the list; the list is made distinct first, so no row multiplies."""
    hits = listed.select(F.col(list_key).alias("_k")).where(X.valid_id(F.col("_k"))).distinct().withColumn("_hit", F.lit(1))
    out = payments.join(hits, payments[key] == hits["_k"], "left")
    return out.withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_k", "_hit")


def fuzzy_matches(people: DataFrame, listed: DataFrame) -> DataFrame:
    """``state, last, first, is_match int, confidence double``: a row per distinct person (normalised names).

    listed: state, last, first of the list's entries, normalised. Blocks are the state and the last name's first two
    letters; entries without a last name and null states match nothing. Bigrams are made once a name, before that
    equi-join, whose condition holds pairs back that their numbers of bigrams keep from COMPONENT. People of a block of
    more than BLOCK are dealt to several tasks, with the list's few entries copied to each.
    """
    keys = people.select("state", "last", "first").distinct()
    block = F.substring("last", 1, 2).alias("block")
    left = keys.where("last <> ''").select("state", block, "last", "first", X.bigrams(F.col("last")).alias("last_grams"), X.bigrams(F.col("first")).alias("first_grams"))
    entries = listed.where("last <> ''").select("state", "last", "first").distinct()
    right = entries.select("state", block, X.bigrams(F.col("last")).alias("l_last_grams"), X.bigrams(F.col("first")).alias("l_first_grams"))
    size = left.groupBy("state", "block").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    right = right.join(size, ["state", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    left = left.join(size, ["state", "block"]).withColumn("part", F.pmod(F.xxhash64("last", "first"), "parts")).drop("parts")
    few = lambda a, b: 2 * F.least(F.size(a), F.size(b)) >= COMPONENT * (F.size(a) + F.size(b))
    pairs = left.join(right, ["state", "block", "part"]).where(few("last_grams", "l_last_grams") & few("first_grams", "l_first_grams"))
    pairs = pairs.withColumn("dl", X.dice(F.col("last_grams"), F.col("l_last_grams"))).withColumn("df", X.dice(F.col("first_grams"), F.col("l_first_grams"))).where((F.col("dl") >= COMPONENT) & (F.col("df") >= COMPONENT))
    best = pairs.groupBy("state", "last", "first").agg(F.max(F.col("dl") * LAST + F.col("df") * FIRST).alias("best"))
    out = keys.join(best, ["state", "last", "first"], "left")
    return out.select("state", "last", "first", F.coalesce(F.col("best") >= MATCH, F.lit(False)).cast("int").alias("is_match"), F.coalesce(F.floor(F.col("best") * 1e4 + 0.5) / 1e4, F.lit(0.0)).alias("confidence"))


def label_table(payments: DataFrame, listed: DataFrame) -> DataFrame:
    """payments with ``is_excluded int, is_excluded_name_match int, match_confidence double``, a row for a row.

    payments: npi, last, first, state; listed: npi, last, first, state; names are as they come. A payment whose valid
    npi is on the list is excluded. By name it is matched to the entries that have no valid npi, once for each
    distinct person; payments without a last name match nobody.
    """
    names = lambda df: df.select("*", X.normalize_state(F.col("state")).alias("_state"), X.normalize_name(F.col("last")).alias("_last"), X.normalize_name(F.col("first")).alias("_first"))
    person = lambda df: df.select(F.col("_state").alias("state"), F.col("_last").alias("last"), F.col("_first").alias("first"))
    rows = names(exact_flag(payments, listed, "npi", "npi"))
    unnamed = names(listed.where(~F.coalesce(X.valid_id(F.col("npi")), F.lit(False))))
    found = fuzzy_matches(person(rows), person(unnamed))
    same = F.col("_state").eqNullSafe(F.col("f.state")) & F.col("_last").eqNullSafe(F.col("f.last")) & F.col("_first").eqNullSafe(F.col("f.first"))
    out = rows.alias("r").join(found.alias("f"), same, "left")
    return out.select(*(f"r.{c}" for c in payments.columns), "r.is_excluded", F.coalesce("f.is_match", F.lit(0)).alias("is_excluded_name_match"), F.coalesce("f.confidence", F.lit(0.0)).alias("match_confidence"))


def label_summary(labels: DataFrame, exact: str, fuzzy: str) -> DataFrame:
    e, f = F.col(exact), F.col(fuzzy)
    return labels.agg(F.count("*").alias("n_rows"), F.sum(e).alias("n_exact"), F.sum(f).alias("n_fuzzy"), F.sum(e * f).alias("n_both"), X.r6(X.divide(F.sum(e), F.count("*"))).alias("exact_rate"))


def misaligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one table has, or that either has twice: none if the tables describe the same records."""
    count = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    both = count(a, "n_left").join(count(b, "n_right"), key, "full")
    return both.select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right")).where("n_left <> 1 or n_right <> 1")


def attach_ids(wanted: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """wanted with the lookup's value; a key that lookup lacks or has twice is an error, a null value is not."""
    double = lookup.groupBy(key).count().where("count > 1")
    if not double.isEmpty():
        raise ValueError(f"{key} is not unique in the lookup")
    if not wanted.join(lookup, key, "left_anti").isEmpty():
        raise ValueError(f"some {key} have no row in the lookup")
    return wanted.join(lookup.select(key, value), key)
