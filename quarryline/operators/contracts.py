"""Joins that keep their contract: cardinality and completeness are checked by the job that joins, without another scan.

A side that must be unique is numbered within each key by a window over the join's own keys, so Spark sorts it
once for both; the second row of a key is an error of the task that meets it. A miss that mustn't be is an error of the
join's row. Rows without a whole key never match, as in SQL; they count as misses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A contract that names what isn't there."""


def _must(ok: Column, message: Column | str) -> Column:
    """True, or an error at run time."""
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message if isinstance(message, Column) else F.lit(message)).cast("boolean"))


def _said(keys: list[str], prefix: str = "") -> Column:
    return F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"{prefix}{k}").cast("string"), F.lit("null"))) for k in keys))


def unique_by(df: DataFrame, keys: list[str], side: str = "table") -> DataFrame:
    """The rows, of which no two have the same (whole) key; else the job fails and names one."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return df.withColumn("_nr", n).where(_must((F.col("_nr") == 1) | ~whole, F.concat(F.lit(f"the {side} has several rows of "), _said(keys)))).drop("_nr")


CARDINALITY = {"one_to_one": (True, True), "one_to_many": (True, False), "many_to_one": (False, True), "many_to_many": (False, False)}


def join(left: DataFrame, right: DataFrame, keys: list[str], cardinality: str = "many_to_one", misses: str = "keep", matched: str | None = None) -> DataFrame:
    """A join by key with its contract. ``misses``: what happens to left rows without a match: ``keep`` (a left
    join), ``drop`` (an inner one), ``fail``; ``fail_both``: right rows without a match fail, too (equal sets of keys).
    ``matched`` names a column that says whether a row found its match."""
    if cardinality not in CARDINALITY or misses not in ("keep", "drop", "fail", "fail_both"):
        raise ContractError(f"unknown contract: {cardinality}, {misses}")
    if clash := sorted(set(left.columns) & set(right.columns) - set(keys)):
        raise ContractError(f"both sides have {clash}")
    one_left, one_right = CARDINALITY[cardinality]
    a = (unique_by(left, keys, "left side") if one_left else left).withColumn("_left", F.lit(True))
    b = (unique_by(right, keys, "right side") if one_right else right).withColumn("_right", F.lit(True))
    # sizes of made-up columns are guessed far too low, and a side that is broadcast passes through the driver
    got = a.hint("merge").join(b, keys, {"keep": "left", "drop": "inner", "fail": "left", "fail_both": "full"}[misses])
    if misses.startswith("fail"):
        got = got.where(_must(F.col("_right").isNotNull(), F.concat(F.lit("no match on the right for "), _said(keys))))
    if misses == "fail_both":
        got = got.where(_must(F.col("_left").isNotNull(), F.concat(F.lit("no match on the left for "), _said(keys))))
    if matched:
        got = got.withColumn(matched, F.col("_right").isNotNull())
    return got.drop("_left", "_right")


def observed(left: DataFrame, right: DataFrame, keys: list[str], name: str = "join", **contract) -> tuple[DataFrame, Observation]:
    """The join with its rows and misses counted while some action runs it (``Observation.get`` afterwards)."""
    seen = Observation(name)
    got = join(left, right, keys, matched="_met", **contract)
    return got.observe(seen, F.count("*").alias("rows"), F.count_if(~F.col("_met")).alias("misses")).drop("_met"), seen


def same_ids(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Several tables' ids, which must be the same set, each once a table: the ids. One shuffle for all; the job fails
    and names an id and the tables that lack or repeat it."""
    names = list(parts)
    rows = reduce(DataFrame.unionByName, [df.select(F.col(key), F.lit(i).alias("_part")) for i, df in enumerate(parts.values())])
    counts = [F.count_if(F.col("_part") == i).alias(f"_n{i}") for i in range(len(names))]
    wrong = F.array_compact(F.array(*(F.when(F.col(f"_n{i}") != 1, F.concat(F.lit(f"{n} has "), F.col(f"_n{i}").cast("string"))) for i, n in enumerate(names))))
    ok = reduce(Column.__and__, [F.col(f"_n{i}") == 1 for i in range(len(names))])
    return rows.groupBy(key).agg(*counts).where(_must(ok, F.concat(_said([key]), F.lit(": "), F.concat_ws(", ", wrong)))).select(key)


def complete(items: DataFrame, ids: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """Every id with every group (``groups``: a handful of rows, such as methods), once each: the items with what is missing kept as rows of
    nulls and ``missing`` true. An item of another id or group, or twice the same, fails."""
    grid = ids.select(key).crossJoin(F.broadcast(groups.select(group)))
    return join(grid, items, [key, group], "one_to_one", "keep", "_met").withColumn("missing", ~F.col("_met")).drop("_met")
