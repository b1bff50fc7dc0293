"""Column expressions: normalisation, flags, similarity, safe arithmetic and the portable hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(c: Column) -> Column:
    """Upper case, letters A-Z and single blanks only; null is empty."""
    letters = F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"[^A-Z\s]", "")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def normalize_state(c: Column) -> Column:
    return F.upper(F.trim(c))


def list_id(c: Column) -> Column:
    """An exclusion-list id: blank and all-zero ids are empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.isin("", "0000000000"), F.lit("")).otherwise(t)


def valid_id(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def bigrams(c: Column) -> Column:
    """The set of two-letter pieces; a single letter is its own piece, an empty text has none."""
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))
    return F.when(F.length(c) >= 2, pairs).when(F.length(c) == 1, F.array(c)).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared pieces over all pieces of two bigram sets; 0 if either is empty."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def log_amount(c: Column) -> Column:
    """ln(1 + x) with negative amounts as 0; null stays null."""
    return F.log1p(F.when(c < 0, F.lit(0.0)).otherwise(c))


def parse_date(c: Column, pattern: str = "MM/dd/yyyy") -> Column:
    """A date, null where the text isn't one."""
    return F.try_to_timestamp(c, F.lit(pattern)).cast("date")


def yes_flag(c: Column) -> Column:
    return F.coalesce(c == "Yes", F.lit(False)).cast("int")


def third_party_flag(c: Column, none: str = "No Third Party Payment") -> Column:
    """0 only for the one value that says no; null counts as 1."""
    return (~c.eqNullSafe(F.lit(none))).cast("int")


def remap(c: Column, names: dict[str, str], default: str = "other") -> Column:
    out = None
    for k, v in names.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(F.lit(default))


def truncated(c: Column, n: int = 40) -> Column:
    """The first n characters, for labels of charts."""
    return F.substring(c, 1, n)


def missing(c: Column, name: str = "Missing") -> Column:
    return F.coalesce(c, F.lit(name))


def divide(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def portable_hash(key: Column, seed: int = 42) -> Column:
    """32 bits of md5 over key and seed, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")


def r6(c: Column) -> Column:
    """Half up at six decimals, the same in any engine."""
    return F.floor(c * 1e6 + 0.5).cast("double") / 1e6


def money(c: Column) -> Column:
    """An exact sum of amounts in cents, as a double."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")
