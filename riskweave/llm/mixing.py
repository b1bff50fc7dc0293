"""Mixing sources to target weights with Sainte-Lague apportionment. DataFrame functions only.

Every source gets a target number of words. Its documents are dealt by hash to shards of bounded size and put in a
seeded order; the words of a shard, read in that order, are its blocks of BLOCK words. Seats (blocks) go to sources,
and then within each source to shards, by the highest quotients votes / (2 s + 1); a shard takes the first blocks of
its order, and goes round again where its quota exceeds its length. So blocks are whole runs of documents, only the
last document of a shard is cut, and no window ever sees more than one shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.llm.common import Scratch, load, quoted

#: Words of a block; words and rows of a shard; most shards of a source (shards grow beyond that).
BLOCK, SHARD_WORDS, SHARD_ROWS, MOST_SHARDS, SEED = 16, 200_000, 2_000, 100_000, 42
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, source_rows, target``: a row per source.

    Weights go to sources by code point, null last, repeating. Water-filling in one ordered pass: sources by how soon
    they reach their limit; from the first on that doesn't, all share what is left by weight.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")).withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    order = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    own = own.withColumn("left", F.sum("source_size").over(W.partitionBy()) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    own = own.withColumn("level", F.col("left") / F.sum("w").over(after)).withColumn("open", F.col("level") * F.col("w") < F.col("most"))
    # the level of the first source that stays below its limit holds for all after it
    level = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("w"), F.col("level")))).over(W.partitionBy())["level"]
    fill = F.least(F.col("most"), F.coalesce(level * F.col("w"), F.col("most")))
    return own.select("source", "source_size", "source_rows", fill.alias("target"))


def seats(parties: DataFrame, group: list[str], key: Column, votes: str, house: str, most: str) -> DataFrame:
    """Adds ``quota long``: the seats of each party of a group by Sainte-Lague's highest quotients.

    Seats that every party surely has come from a divisor that is a bit too high, the doubtful ones (about two for
    each party) are ranked by quotient, ties by key. No party gets more than its column most.
    """
    by = W.partitionBy(*group)
    n, total, seats_of = F.count("*").over(by), F.sum(votes).over(by), F.col(house)
    low, high = (F.when(seats_of - n / 2.0 - 1 > 0, F.col(votes) / total * (seats_of - n / 2.0 - 1)).otherwise(F.lit(-0.5)), F.col(votes) / total * (seats_of + n / 2.0 + 1))
    base = F.greatest(F.lit(0), F.floor(low + 0.5))
    parties = parties.withColumn("_base", F.when(total > 0, F.least(base, F.col(most))).otherwise(F.lit(0)).cast("long"))
    parties = parties.withColumn("_top", F.when(total > 0, F.least(F.floor(high + 0.5), F.col(most))).otherwise(F.lit(0)).cast("long"))
    parties = parties.withColumn("_open", F.greatest(F.lit(0), seats_of - F.sum("_base").over(by))).withColumn("_key", key)
    doubtful = parties.where("_top > _base").select(*group, "_key", "_open", votes, F.explode(F.sequence("_base", F.col("_top") - 1)).alias("s"))
    rank = F.row_number().over(W.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("s") + 1)).desc(), "_key", "s"))
    won = doubtful.withColumn("_rank", rank).where("_rank <= _open").groupBy(*group, "_key").agg(F.count("*").alias("_won"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_key"]]
    joined = parties.alias("a").join(won.alias("b"), same, "left")
    return joined.select("a.*", (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("quota")).drop("_base", "_top", "_open", "_key")


def mix(docs: DataFrame, scratch: Scratch | None = None, block: int = BLOCK, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, most_shards: int = MOST_SHARDS, seed: int = SEED, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, whole, extra``: a row per row of docs.

    taken = whole * size + extra words: the mix takes the text whole times and then its first extra words once more.
    A null text has size 0; a null source is a source of its own, the last. No words at all: all targets are 0. An
    empty table gives an empty result; repeated rows are separate documents; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    sized = scratch.keep(sizes(docs))
    sources = targets(sized, weights, share, repeats)
    shards = F.greatest(F.lit(1), F.least(F.lit(most_shards), F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / shard_rows)))).cast("long")
    house = F.round(F.sum("target").over(W.partitionBy()) / block)
    full = F.col("source_size") * repeats
    sources = sources.withColumn("shards", shards).withColumn("_one", F.lit(1)).withColumn("house", house).withColumn("limit", F.ceil(full / block))
    sources = seats(sources, ["_one"], F.col("source"), "target", "house", "limit").withColumn("capped", F.col("target") >= full)
    sources = scratch.keep(sources.select("source", "source_size", "target", "shards", "capped", F.col("quota").alias("source_quota")))
    # every row has a source and the sources' rows are few, but their number has no bound: the salt spreads a hot one
    salts = 64
    spread = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = sized.withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(salts)).cast("int"))
    placed = left.alias("a").join(spread.alias("b"), F.col("a._salt").eqNullSafe(F.col("b._salt")) & F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.doc_id", "a.source", "a.size", "b.source_size", "b.target", "b.capped", "b.source_quota", F.pmod(F.xxhash64("a.doc_id", F.lit(seed)), F.col("b.shards")).alias("shard"))
    per = placed.groupBy("source", "shard", "capped", "source_quota").agg(F.sum("size").alias("words"))
    per = per.withColumn("_sid", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).withColumn("limit", F.ceil(F.col("words") * repeats / block))
    quotas = seats(per, ["_sid"], F.col("shard"), "words", "source_quota", "limit")
    blocks = F.ceil(F.col("words") / block)
    full_rounds = F.when(F.col("capped"), F.lit(repeats)).when(F.col("words") == 0, F.lit(0)).otherwise(F.least(F.floor(F.col("quota") / F.greatest(blocks, F.lit(1))), F.lit(repeats))).cast("long")
    quotas = quotas.withColumn("whole", full_rounds)
    quotas = quotas.withColumn("rest", F.when(F.col("whole") >= repeats, F.lit(0)).otherwise((F.col("quota") - F.col("whole") * blocks) * block).cast("long")).select("_sid", "shard", "whole", "rest")
    keyed = placed.withColumn("_sid", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    order = W.partitionBy("_sid", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    keyed = keyed.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    out = keyed.join(quotas, ["_sid", "shard"]).withColumn("extra", extra)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"), "whole", "extra")


def mixed_documents(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """The mix itself: the columns of docs, a row for each time a text is taken, a cut last text as its first words.

    Rows that share a doc_id (null ones too) are all taken as the mix takes the one it takes most of; a document of which the mix
    takes no word, so any without words, is not in it.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    taken = mix(docs, scratch, **options).where("taken > 0").groupBy(F.col("doc_id").alias("of")).agg(F.max(F.struct("whole", "extra")).alias("most"))
    plan = scratch.keep(taken.select("of", "most.*"))
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int")), F.when(F.col("extra") > 0, F.array("extra")).otherwise(F.array().cast("array<long>")))
    joined = rows.join(plan.hint("merge"), F.col("id").eqNullSafe(F.col("of"))).select("row", F.explode(copies).alias("copy"))
    words = F.slice(F.filter(F.split(F.col("row.text"), "[\\x20\\x09-\\x0D]"), lambda x: x != ""), 1, F.col("copy").cast("int"))
    joined = joined.withColumn("new", F.when(F.col("copy") < 0, F.col("row.text")).otherwise(F.array_join(words, " ")))
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("copy") < 0, own["n_chars"]).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(c.alias(n) for n, c in own.items()))


def op2_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
