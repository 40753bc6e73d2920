"""Files in and out: formats by suffix, a registry of sources, and sinks with guards.

Paths are URIs that driver and executors share. A sink writes a new folder beside its target and reads it back through
Spark before it counts, so a guard that fails leaves the target as it was."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from . import csvscan


def scan_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted fields over several lines, and doubled quotes, a file by many tasks (see ``csvscan``)."""
    return csvscan.scan(spark, path, schema)


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, CSV, JSON lines, or a JSON document: a list of records, or an object whose ``labels`` holds them."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind in ("csv", "txt"):
        return scan_csv(spark, path, schema)
    if kind in ("jsonl", "ndjson"):
        return spark.read.json(path, schema=schema) if schema else spark.read.json(path)
    if kind == "json":
        whole = spark.read.option("multiLine", True).json(path)
        return whole.select(F.explode("labels").alias("x")).select("x.*") if "labels" in whole.columns else whole
    raise ValueError(f"unknown kind of file: {path}")


def manifest_ids(spark: SparkSession, path: str, name: str, column: str = "job_id") -> DataFrame:
    """The ids that a JSON manifest lists under a name."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(F.col(name).cast("array<bigint>")).alias(column))


class Registry:
    """Sources by name: a path (its suffix tells the format), and the rules that its rows must keep: columns that are keys, and
    conditions by name."""

    def __init__(self, spark: SparkSession, root: str, sources: dict[str, str], keys: dict[str, list[str]] | None = None, rules: dict[str, dict[str, Column]] | None = None):
        self.spark, self.root, self.sources = spark, root.rstrip("/"), sources
        self.keys, self.rules = keys or {}, rules or {}
        if unknown := sorted((set(self.keys) | set(self.rules)) - set(sources)):
            raise KeyError(f"rules of unknown sources: {unknown}")

    def read(self, name: str) -> DataFrame:
        if name not in self.sources:
            raise KeyError(f"no source named {name!r}; there are {sorted(self.sources)}")
        return read_any(self.spark, f"{self.root}/{self.sources[name]}")

    def report(self, name: str) -> DataFrame:
        """``rule, failures`` of a source."""
        df, keys = self.read(name), self.keys.get(name, [])
        rules = {f"has_{k}": F.col(k).isNotNull() for k in keys} | self.rules.get(name, {})
        parts = ([Q.holds(df, rules)] if rules else []) + ([Q.unique(df, keys)] if keys else [])
        return Q.report(*parts) if parts else self.spark.createDataFrame([], "rule string, failures bigint")

    def checked(self, name: str) -> DataFrame:
        """A source whose rules hold; else an error that names those which don't."""
        Q.raise_on_failures(self.report(name))
        return self.read(name)

    def views(self) -> list[str]:
        """A view a source, for SQL."""
        for name in self.sources:
            self.read(name).createOrReplaceTempView(name)
        return sorted(self.sources)


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _path(spark, uri)
    return fs.exists(path)


def names(spark: SparkSession, uri: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    fs, path = _path(spark, uri)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def aside(folder: str) -> str:
    """A new place in a folder for something to be written before it counts."""
    return f"{folder.rstrip('/')}/_aside-{uuid.uuid4().hex}"


def put(spark: SparkSession, new: str, target: str) -> bool:
    """Put a finished folder in a place that is free; if it isn't, the folder goes and False is returned."""
    fs, to = _path(spark, target)
    _, path = _path(spark, new)
    if not fs.exists(to) and fs.rename(path, to):
        return True
    fs.delete(path, True)
    return False


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``. Where that is unset, local runs and
    tests get a temporary one; a cluster has no folder that all machines share, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quarryline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def restore(spark: SparkSession, target: str) -> None:
    """Put back what a run that died while it swapped has left beside the target."""
    fs, to = _path(spark, target)
    _, old = _path(spark, f"{target}.old")
    if fs.exists(old) and not fs.exists(to):
        fs.rename(old, to)


def swap(spark: SparkSession, new: str, target: str) -> None:
    """Put a finished folder in the place of its target, whose rows are never deleted while they are the only copy."""
    restore(spark, target)
    fs, to = _path(spark, target)
    _, old = _path(spark, f"{target}.old")
    fs.delete(old, True)
    if fs.exists(to) and not fs.rename(to, old):
        raise OSError(f"{target} can't be moved away")
    if not fs.rename(_path(spark, new)[1], to):
        raise OSError(f"{new} can't be moved to {target}")
    fs.delete(old, True)


def write_guarded(df: DataFrame, target: str, keys: list[str] | None = None, may_shrink: bool = False, kind: str = "parquet", partition_by: list[str] | None = None) -> int:
    """Write a table, check what was written, and only then put it in place of the target. It must not have fewer rows
    than the present one unless it may, and its keys must be there and unique. Returns the rows written."""
    spark, new = df.sparkSession, f"{target}.new"
    restore(spark, target)
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(new)
    back = (lambda p: spark.read.schema(df.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(p)) if kind == "csv" else (lambda p: spark.read.schema(df.schema).format(kind).load(p))
    rows = back(new).count()
    if not may_shrink and exists(spark, target) and rows < (had := back(target).count()):
        raise ValueError(f"{target} would shrink from {had} to {rows} rows")
    if keys:
        Q.raise_on_failures(Q.report(Q.holds(back(new), {f"has_{k}": F.col(k).isNotNull() for k in keys}), Q.unique(back(new), keys)))
    swap(spark, new, target)
    return rows


def records(df: DataFrame) -> DataFrame:
    """Rows as JSON texts with every field in place: nulls are written, and what JSON has no number for (NaN and the
    infinities) is null."""
    plain = lambda f: F.when(~F.isnan(f.name) & (F.abs(F.col(f.name)) != float("inf")), F.col(f.name)) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
    return df.select(F.to_json(F.struct(*(plain(f).alias(f.name) for f in df.schema.fields)), {"ignoreNullFields": "false"}).alias("value"))


def export(df: DataFrame, target: str, allowed: list[str], top: tuple[str, int] | None = None, keys: list[str] | None = None, kind: str = "json") -> int:
    """An export of the allowed columns alone, in their order; an allowed column that isn't there is an error, one that
    isn't allowed never leaves. ``top`` keeps the highest rows by a column (ties by the other columns). What was written
    is read back, and must have just these columns, before it takes its place."""
    if missing := [c for c in allowed if c not in df.columns]:
        raise ValueError(f"columns to export are missing: {missing}")
    kept = df.select(*allowed)
    if top:
        kept = kept.orderBy(F.desc_nulls_last(top[0]), *[c for c in kept.columns if c != top[0]]).limit(top[1])
    if kind != "json":
        return write_guarded(kept, target, keys, may_shrink=True, kind=kind)
    spark, new = df.sparkSession, f"{target}.new"
    records(kept).write.mode("overwrite").text(new)
    back = spark.read.schema(kept.schema).json(new)
    broken = F.count_if(F.sort_array(F.json_object_keys("value")) != F.array(*map(F.lit, sorted(allowed))))
    rows, odd = spark.read.text(new).agg(F.count("*"), broken).first()
    if odd:
        raise ValueError(f"{odd} records have other fields than {allowed}")
    if keys:
        Q.raise_on_failures(Q.report(Q.holds(back, {f"has_{k}": F.col(k).isNotNull() for k in keys}), Q.unique(back, keys)))
    swap(spark, new, target)
    return rows


def layered(tables: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Write tables in order and give each back as a scan of its files, so that later layers read finished ones."""
    out = {}
    for name, df in tables.items():
        write_guarded(df, f"{root.rstrip('/')}/{name}", may_shrink=True)
        out[name] = df.sparkSession.read.parquet(f"{root.rstrip('/')}/{name}")
    return out
