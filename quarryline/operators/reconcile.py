"""Two tables with the same key, compared by order-free fingerprints of key ranges, then row by row where these differ.

Keys fall into ranges of their hash. A range's fingerprint is its number of rows and sums of its rows' hashes, which
combine map-side whatever the order, so equal tables cost two scans and a few rows of shuffle. Only the rows of ranges
that differ are joined, by key, and compared column by column, numbers with a tolerance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import numeric_equal

RANGES = 4096
NUMBERS = ("double", "float")


def _range(keys: list[str], ranges: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int").alias("range")


def fingerprints(df: DataFrame, keys: list[str], columns: list[str], ranges: int = RANGES) -> DataFrame:
    """``range, n, low, high``: rows of each key range, and the sums of both halves of their hashes."""
    h = F.xxhash64(*keys, *columns)
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)
    return df.select(_range(keys, ranges), low.alias("l"), high.alias("h")).groupBy("range").agg(F.count("*").alias("n"), F.sum("l").alias("low"), F.sum("h").alias("high"))


def suspects(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], ranges: int = RANGES) -> DataFrame:
    """The key ranges whose fingerprints differ (at most ``ranges`` rows)."""
    both = fingerprints(a, keys, columns, ranges).withColumn("s", F.lit(1)).unionByName(fingerprints(b, keys, columns, ranges).withColumn("s", F.lit(-1)))
    sums = both.groupBy("range").agg(*(F.sum(F.col(c) * F.col("s")).alias(c) for c in ("n", "low", "high")))
    return sums.where("n <> 0 or low <> 0 or high <> 0").select("range")


def differences(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str] | None = None, atol: float = 1e-10, rtol: float = 1e-10, ranges: int = RANGES) -> DataFrame:
    """``keys, status, columns, left_rows, right_rows``: keys that only one side has (``left_only``, ``right_only``), that
    a side has several times and whose rows aren't the same in all (``repeated``), and whose rows differ (``changed``, with the columns that do). Null equals null."""
    columns = columns or [c for c in a.columns if c not in keys]
    if missing := [c for c in [*keys, *columns] if c not in a.columns or c not in b.columns]:
        raise ValueError(f"columns to compare are missing: {missing}")
    kinds = dict(a.select(*columns).dtypes)
    odd = F.broadcast(suspects(a, b, keys, columns, ranges))  # bounded by `ranges`

    def side(df: DataFrame, name: str) -> DataFrame:
        kept = df.withColumn("range", _range(keys, ranges)).join(odd, "range", "left_semi")
        h = F.xxhash64(*columns)
        rows = F.first(F.struct(*columns)).alias(name)  # one row, unless the key is repeated
        return kept.groupBy(*keys).agg(F.count("*").alias(f"{name}_rows"), rows, F.sum(h.bitwiseAND(0xFFFFFFFF)).alias(f"{name}_low"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"{name}_high"))

    same = reduce(Column.__and__, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    both = side(a, "left").alias("x").join(side(b, "right").alias("y"), same, "full")

    def changed(c: str) -> Column:
        p, q = F.col(f"left.{c}"), F.col(f"right.{c}")
        equal = numeric_equal(p, q, atol, rtol) if kinds[c] in NUMBERS else p.eqNullSafe(q)
        return F.when(~F.coalesce(equal, F.lit(False)), F.lit(c))

    n, m = F.coalesce("left_rows", F.lit(0)), F.coalesce("right_rows", F.lit(0))
    told = both.select(*(F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys), n.alias("left_rows"), m.alias("right_rows"), F.array_compact(F.array(*map(changed, columns))).alias("_c"), ((F.col("left_rows") > 1) | (F.col("right_rows") > 1)).alias("_many"), ((n == m) & (F.col("left_low") == F.col("right_low")) & (F.col("left_high") == F.col("right_high"))).alias("_same"))
    status = F.when(F.col("right_rows") == 0, "left_only").when(F.col("left_rows") == 0, "right_only").when(F.col("_many"), F.when(~F.col("_same"), "repeated")).when(F.size("_c") > 0, "changed")
    return told.select(*keys, status.alias("status"), F.when(status == "changed", F.concat_ws(",", "_c")).alias("columns"), "left_rows", "right_rows").where("status is not null")


def summary(found: DataFrame) -> DataFrame:
    """``status, columns, n`` of differences."""
    return found.groupBy("status", "columns").agg(F.count("*").alias("n"))
