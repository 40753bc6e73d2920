"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, encoding.

Each stage reads all that its predecessor kept and, but for the last, returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bpe, decontaminate, jaccard, pii, toxicity
from quarryline.llm.common import cut, shared_dir, table


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Learns from the labelled documents that are here."""
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that link, directly or over others, one stays: that with the smallest doc_id (null comes last; among
    equal ids the first row). Rows are numbered and told apart by number, not by doc_id, so copies under repeated or null
    ids go, too. Rows without words link with nothing: of equal ones, one stays."""
    rows = cut(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.monotonically_increasing_id().alias("row")), "numbered")
    found = jaccard.jaccard_join(rows.select(F.col("row").alias("doc_id"), "d.text"))
    told = found.join(rows.select("row", F.col("d.doc_id").alias("id")), found["doc_id"] == F.col("row"))
    lead = told.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")).select("m.row")
    return rows.join(lead, "row", "left_semi").select("d.*").dropDuplicates()


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth or more lies in benchmark passages go; the others stay as they are, with null, empty
    and repeated ones, and whatever further columns they have. An empty benchmark keeps all."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced, and n_chars follows; no row goes. Null and empty texts stay as they are (n_chars
    null and 0); the model learns from a sample of these rows."""
    return pii.redacted(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("bigint"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row's text and what they decode to; a null text has none. A row a row, repeated ones too."""
    return bpe.encode_documents(docs)


STAGES = [("toxicity", civil), ("near_duplicates", unique), ("decontamination", clean), ("pii", private), ("bpe", encoded)]
#: The trained stages have no SQL form; tests hold each stage against a brute-force version (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
