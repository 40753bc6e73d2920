"""What the corpus operators share: reading tables, bounded Arrow batches, shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long, so batches are small: memory in a Python worker
#: follows the longest texts, not the partition.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``. Where that is unset, local runs
    and tests get a temporary one; a cluster has no folder that all machines share, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quarryline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list, list], list]],
    schema: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One output row per input row: ``make()`` builds, once a task, a function from the batch's
    keys and texts (None stays None) to the columns after the key. Only key and text are read, so
    further columns, whatever their names, do no harm.

    ``schema`` is the DDL of the columns that follow the key."""
    spark = docs.sparkSession
    bound_batches(spark)
    picked = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))
    out = f"`{key}` {picked.schema[0].dataType.simpleString()}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            cols = fn(batch.column(0), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(out).fields]
    return picked.mapInArrow(run, out)


class Recent(dict):
    """A bounded cache in two generations: when the young one is full it becomes the old one, and
    what is then still used moves back. ``make(key)`` computes what neither holds."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
