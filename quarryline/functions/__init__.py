"""Column helpers shared by the marts and scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a believable annual salary is, and periods a year.
SALARY_LOW, SALARY_HIGH = 10_000, 500_000
SALARY_PERIODS = ["YEARLY", "HOURLY", "MONTHLY", "WEEKLY"]
PERIODS = {"HOURLY": 2080, "WEEKLY": 52, "BIWEEKLY": 26, "MONTHLY": 12, "YEARLY": 1}


def rounded(c: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.round(c * scale) / scale


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """A percentage, null over nothing."""
    return F.when(whole > 0, rounded(part.cast("double") * 100.0 / whole, digits))


def valid_salary() -> Column:
    """The normalised salary where it is in dollars, of a known period and believable, else null."""
    ok = (F.col("currency") == "USD") & F.col("pay_period").isin(SALARY_PERIODS) & F.col("normalized_salary").between(SALARY_LOW, SALARY_HIGH)
    return F.when(ok, F.col("normalized_salary"))


def annualized(amount: Column, period: Column) -> Column:
    """An amount a period as one a year; null for other periods."""
    factor = F.lit(None).cast("double")
    for name, n in reversed(PERIODS.items()):
        factor = F.when(period == name, float(n)).otherwise(factor)
    return amount * factor


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def value_bucket(value: Column, per_octave: int = 1024) -> Column:
    """A whole number that never falls as the value rises: so many steps a doubling of its size, 0 for 0, negative for
    negative values, NaN above all (as it is sorted). It depends on the value alone, so any two passes agree."""
    v = value.cast("double")
    step = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * per_octave) + F.lit(2000 * per_octave)
    return F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0)).when(v > 0, step).otherwise(-step).cast("bigint")


def _ranks(wanted: dict[str, float]) -> list[Column]:
    """The place of each quantile among ``_all`` values, from 0, with a fraction."""
    return [(F.col("_all") - 1) * q for q in wanted.values()]


def rank_buckets(counted: DataFrame, keys: list[str], wanted: dict[str, float], per_octave: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Of distinct values ``_v`` with their numbers ``_n`` by key: the size of each bucket of values, with what comes
    before it and the key's whole number, and the values of those buckets alone that hold a wanted rank."""
    dealt = counted.withColumn("_b", value_bucket(F.col("_v"), per_octave))
    by = Window.partitionBy(*(keys or [F.lit(1)]))
    upto = F.sum("_m").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    sizes = dealt.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m")).select(*keys, "_b", "_m", (upto - F.col("_m")).alias("_before"), F.sum("_m").over(by).alias("_all"))
    holds = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m"))
    hit = reduce(Column.__or__, [holds(end) for r in _ranks(wanted) for end in (F.floor(r), F.ceil(r))])
    chosen = sizes.where(hit).select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.col("_b").alias("_c"), "_before", "_all")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)], F.col("_b").eqNullSafe(F.col("_c")))
    # by <=> throughout: an = would tell one side that it isn't null, and the counts would be made once more for that
    near = dealt.join(chosen if keys else F.broadcast(chosen), same)  # without keys: a row a rank
    return sizes, near.select(*keys, "_b", "_v", "_n", "_before", "_all")


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], digits: int | None = 0, per_octave: int = 1024) -> DataFrame:
    """Exact interpolated quantiles of the non-null values by key, one column each, by distributed rank selection.

    Equal values are counted first, map-side too. These counts are added up by buckets of the values (a thousandth part
    of a doubling each, so a key has thousands at most, whatever its rows), the running sum of a key's buckets tells which
    of them hold the wanted ranks, and only their values are sorted, each bucket for itself. So no task sorts a
    key's values, even if there is one key. Values that crowd together closer than that want a higher ``per_octave``."""
    return quantiles_of(cells_of(df.where(F.col(value).isNotNull()), keys, value), keys, wanted, digits, per_octave)


def cells_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How often (``_n``) each value (``_v``, null too) occurs by key. Sums and quantiles that start from the same cells share
    them, so what ``df`` does is done once."""
    return df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))


def in_cells(flag: Column) -> Column:
    """How many rows the cells with the flag stand for."""
    return F.sum(F.when(flag, F.col("_n")).otherwise(0))


def valued(cells: DataFrame) -> DataFrame:
    """The cells of a value that isn't null. The number is part of the condition, so that it stays behind the counting: a
    plain condition would be moved before it, and the cells would be counted a second time."""
    return cells.where(F.col("_n") * F.col("_v").isNotNull().cast("int") > 0)


def quantiles_of(counted: DataFrame, keys: list[str], wanted: dict[str, float], digits: int | None = 0, per_octave: int = 1024) -> DataFrame:
    """The quantiles of cells of values that aren't null; a value may have several cells."""
    _, near = rank_buckets(counted, keys, wanted, per_octave)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = near.withColumn("_upto", upto)
    ends = []
    for i, place in enumerate(_ranks(wanted)):
        at = lambda end: F.min(F.when((F.col("_upto") > end) & (F.col("_upto") - F.col("_n") <= end), F.col("_v")))
        ends += [at(F.floor(place)).alias(f"_low{i}"), at(F.ceil(place)).alias(f"_high{i}"), F.first(place - F.floor(place)).alias(f"_part{i}")]
    got = placed.groupBy(*keys).agg(*ends)
    between = lambda i: F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")
    return got.select(*keys, *((between(i) if digits is None else rounded(between(i), digits)).alias(name) for i, name in enumerate(wanted)))


def with_quantiles(sums: DataFrame, df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], digits: int | None = 0) -> DataFrame:
    """The aggregates with quantiles beside them (keys may be null)."""
    q = quantiles(df, keys, value, wanted, digits)
    return beside(sums, q, keys) if keys else sums.join(F.broadcast(q), how="left")  # one row each


def beside(sums: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """The aggregates of all keys with the quantiles of those that have any."""
    named = q.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in q.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return sums.join(named, same, "left").drop(*(f"_{k}" for k in keys))


def f1_or(tp: Column, fp: Column, fn: Column, empty: float) -> Column:
    """F1 from counts; ``empty`` where nothing was there and nothing was found."""
    whole = 2 * tp + fp + fn
    return F.when(whole > 0, 2.0 * tp / whole).otherwise(F.lit(empty))


def ratio(part: Column, whole: Column) -> Column:
    """0 over nothing."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)
