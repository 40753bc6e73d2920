"""Quality rules as small reports: ``rule, failures`` rows, zero where all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rounded


def _row(df: DataFrame, rule: str, failures: Column) -> DataFrame:
    return df.agg(F.lit(rule).alias("rule"), F.coalesce(failures, F.lit(0)).cast("bigint").alias("failures"))


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def holds(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule (null counts as broken), all in one pass."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failures")) for n in rules])))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each combination of keys."""
    return _row(df.groupBy(*keys).count(), "unique_" + "_".join(keys), F.sum(F.col("count") - 1))


def accepted(column: str, values: list, where: Column | None = None) -> dict[str, Column]:
    rule = F.col(column).isNull() | F.col(column).isin(values)
    return {f"accepted_{column}": rule if where is None else ~F.coalesce(where, F.lit(False)) | rule}


def in_range(column: str, low=None, high=None) -> dict[str, Column]:
    c, rule = F.col(column), F.lit(True)
    if low is not None:
        rule = rule & (c >= low)
    if high is not None:
        rule = rule & (c <= high)
    return {f"range_{column}": c.isNull() | rule}


def disjoint(left: str, right: str) -> dict[str, Column]:
    return {f"disjoint_{left}_{right}": ~F.arrays_overlap(F.coalesce(left, F.array().cast("array<string>")), F.coalesce(right, F.array().cast("array<string>")))}


def numeric_equal(a: Column, b: Column, atol: float = 1e-10, rtol: float = 1e-10) -> Column:
    """Equal within tolerances; null and not-a-number equal their like."""
    return a.eqNullSafe(b) | F.coalesce((F.abs(a - b) <= atol + rtol * F.abs(b)) | (F.isnan(a) & F.isnan(b)), F.lit(False))


def reconciled(rule: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """One-row tables with equal columns: how many columns differ."""
    r = right.select(*(F.col(c).alias(f"_{c}") for c in right.columns))
    same = [(~numeric_equal(F.col(c).cast("double"), F.col(f"_{c}").cast("double"))).cast("int") for c in left.columns]
    return _row(left.join(F.broadcast(r)), rule, F.sum(sum(same, F.lit(0))))  # one row each


def all_present(rule: str, wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return _row(wanted.select(key).distinct().join(df.select(key).hint("merge"), key, "left_anti"), rule, F.count("*"))


def no_overlap(rule: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return _row(a.join(b.select(key).hint("merge"), key, "left_semi"), rule, F.count("*"))


def missing_pairs(rule: str, items: DataFrame, predictions: DataFrame, methods: list[str], key: str = "job_id") -> DataFrame:
    """Items without a prediction of each method: the precondition of paired tests."""
    seen = predictions.where(F.col("method").isin(methods)).select(key, "method").distinct().groupBy(key).agg(F.count("*").alias("_n"))
    lacking = items.select(key).join(seen.hint("merge"), key, "left").where(F.coalesce("_n", F.lit(0)) < len(methods))
    return _row(lacking, rule, F.count("*"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """The share of rows in which each field is there, one row a field, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), rounded(100.0 * F.col(c) / F.col("_n"), 1).alias("populated_pct")) for c in columns])))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def raise_on_failures(checked: DataFrame) -> None:
    """Stop a job whose report isn't clean; the driver sees a row a rule."""
    bad = [(r.rule, r.failures) for r in checked.where("failures > 0").collect()]
    if bad:
        raise ValueError(f"quality rules are broken: {bad}")
