"""Layers as catalog tables that are laid out by the key that later joins use.

A table that is bucketed and sorted by the join key is dealt out once, when it is written; joins and aggregations by that key
then read its buckets side by side, without an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def write(df: DataFrame, name: str, key: str, buckets: int = BUCKETS, layer: str = "marts") -> DataFrame:
    """Write a table ``layer.name`` in the warehouse, in ``buckets`` buckets by ``key``, and give it back as a scan. Rows are
    dealt by the key first, so that each bucket is one file, however many tasks wrote it."""
    spark = df.sparkSession
    spark.sql(f"create database if not exists `{layer}`")
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"`{layer}`.`{name}`")
    return spark.table(f"`{layer}`.`{name}`")


def write_all(tables: dict[str, DataFrame], key: str, buckets: int = BUCKETS, layer: str = "marts") -> dict[str, DataFrame]:
    """Tables that share a key, in one layout."""
    return {name: write(df, name, key, buckets, layer) for name, df in tables.items()}


def drop(spark: SparkSession, layer: str) -> None:
    """A layer and its tables."""
    spark.sql(f"drop database if exists `{layer}` cascade")
