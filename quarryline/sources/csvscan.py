"""Quoted CSV with fields over several lines, read by many tasks a file.

A byte range of such a file doesn't tell whether it begins inside a quoted field. The number of quotation marks before it
does: inside, if that is odd (a doubled one counts twice). So a first pass over the ranges that Spark's text source
makes of the files counts each range's quotation marks, and notes whether its lines would ever leave a quoted field that was open
at its start. Running sums of these small rows (one a range) give every range its state, and the range in which the record
that is open at its start began. A second pass then parts the lines into records, all ranges at once: records within a
range come out whole; what is left at a range's ends is a few pieces, which meet by the record they belong to.

Records are parsed by Spark itself (``from_csv``). Quotation marks stand around whole fields and are doubled
within them, as the format has it; a file that ends inside a quoted field is an error. Lines end in LF or CR LF."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, line``: the lines of each range in order, with the range's first byte."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))


def _quotes(lines: pa.Array) -> list[int]:
    return pc.count_substring(lines.fill_null(""), '"').to_pylist()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a range: whether its quotation marks are odd in number, and whether an open field would be closed in it."""
    found: dict[tuple, list] = {}
    for b in batches:
        for file, at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _quotes(b.column(2)), strict=True):
            state = found.setdefault((file, at), [0, False])
            state[0] ^= n & 1
            state[1] |= bool(state[0])
    if found:
        yield pa.RecordBatch.from_pylist([{"file": f, "at": a, "odd": s[0], "closes": s[1]} for (f, a), s in found.items()], schema=pa.schema([("file", pa.string()), ("at", pa.int64()), ("odd", pa.int32()), ("closes", pa.bool_())]))


def ranges_of(lines: DataFrame) -> DataFrame:
    """``file, at, inside, owner``: whether a range begins inside a record, and where the range begins in which that
    record did. A file that ends inside a record is an error."""
    seen = lines.mapInArrow(_counted, "file string, at bigint, odd int, closes boolean")
    by = Window.partitionBy("file").orderBy("at")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    state = seen.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    own = F.when(~F.col("inside") | F.col("closes"), F.col("at"))  # a record begins in this range
    last = F.lead("at").over(by).isNull()
    ends_inside = F.col("inside") != (F.col("odd") == 1)
    checked = F.when(last & ends_inside, F.raise_error(F.concat(F.lit("a quoted field has no end in "), F.col("file"))).cast("boolean")).otherwise(F.col("inside"))
    return state.select("file", "at", checked.alias("inside"), F.last(own, True).over(before).alias("owner"))


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, at, own, header, whole, text``: whole records, and pieces (from the range ``own``) of those that cross the
    ends of ranges; ``at`` is the range in which a record begins, ``header`` marks a file's first."""
    names, types = ["file", "at", "own", "header", "whole", "text"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    place, held, opened, inside, top = None, [], False, False, False
    out: list[tuple] = []

    def piece(whole: bool) -> None:
        # what was open at the range's start belongs to a record of an earlier one
        out.append((place[0], place[2] if opened else place[1], place[1], top, whole and not opened, "\n".join(held)))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for b in batches:
        for file, start, inner, owner, line, n in zip(*(b.column(i).to_pylist() for i in range(5)), _quotes(b.column(4)), strict=True):
            if place is None or (file, start) != place[:2]:
                if held:
                    piece(False)
                if inner is None:
                    raise ValueError("ranges changed between two passes; fix spark.sql.files.minPartitionNum")
                place, held, opened, inside, top = (file, start, owner), [], inner, inner, start == 0
            if not inside and not n & 1:
                out.append((file, start, start, top, True, line))
                top = False
                continue
            held.append(line)
            if n & 1:
                inside = not inside
            if not inside:
                piece(True)
                held, opened, top = [], False, False
        if out:
            yield batch()
            out.clear()
    if held:
        piece(False)
        yield batch()


def records(spark: SparkSession, path: str) -> DataFrame:
    """``header, text``: every record as it stands in the files, and whether it is a file's first."""
    lines = lines_of(spark, path)
    known = F.broadcast(ranges_of(lines))  # a row a range, some 10^-7 of the input
    told = lines.join(known, ["file", "at"], "left").select("file", "at", "inside", "owner", "line")
    parted = told.mapInArrow(_parted, "file string, at bigint, own bigint, header boolean, whole boolean, text string")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("own", "text"))), lambda x: x["text"]), "\n")
    crossing = parted.where("not whole").groupBy("file", "at").agg(F.bool_or("header").alias("header"), text.alias("text"))
    every = parted.where("whole").select("header", "text").unionByName(crossing.select("header", "text"))
    return every.select("header", F.regexp_replace("text", "\r$", "").alias("text")).where("text <> ''")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The names in the first record of the first file."""
    first = spark.read.option("header", True).option("multiLine", False).options(**OPTIONS).csv(path)
    return first.columns


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV files with a header each; a file of several ranges is read by as many tasks. Without a schema, types are the
    narrowest of int, bigint, double, boolean, timestamp and string that hold all values (one more pass)."""
    names = header_of(spark, path)
    strings = ", ".join(f"`{n}` string" for n in names)
    fields = spark.createDataFrame([], schema or strings).schema
    if len(fields) != len(names):
        raise ValueError(f"{len(fields)} columns are wanted, {path} has {names}")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = records(spark, path).where("not header").select(F.from_csv("text", ddl, OPTIONS).alias("r")).select("r.*")
    return rows if schema else typed(rows)


KINDS = ["int", "bigint", "double", "boolean", "timestamp"]


def typed(rows: DataFrame) -> DataFrame:
    """Text columns in the narrowest type that holds all their values."""
    fits = lambda c, kind: F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kind).isNull())
    misses = rows.agg(*(fits(c, k).alias(f"{i}_{k}") for i, c in enumerate(rows.columns) for k in KINDS), *(F.count(f"`{c}`").alias(f"{i}_n") for i, c in enumerate(rows.columns))).first()

    def cast(i: int, name: str) -> Column:
        kind = next((k for k in KINDS if misses[f"{i}_n"] and not misses[f"{i}_{k}"]), "string")
        return F.col(f"`{name}`").cast(kind).alias(name)

    return rows.select(*(cast(i, c) for i, c in enumerate(rows.columns)))
