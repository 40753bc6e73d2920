"""A content-addressed cache of model replies: a table keyed by the hash of model and prompt, which grows by what wasn't in it.

Requests are looked up by key in one join; only distinct keys that have no reply go on to the model, each once, and their
replies are merged. A merge is a batch of new keys under a name: it is written aside, put in place by one rename, and a
batch of that name that is there already is left alone, so that a repeated job changes nothing. Should two jobs have asked for
the same key at once, the reply of the batch whose name comes first counts for both.

A null model or prompt is read as an empty text. What is asked of a model (``call``) maps a DataFrame
``key, model, prompt`` to ``key, reply, input_tokens, output_tokens``; keys that it leaves out stay without a reply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files

SCHEMA = "key string, reply string, input_tokens bigint, output_tokens bigint"


def key_of(model: str = "model", prompt: str = "prompt") -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(F.concat(text(model), F.lit("\0"), text(prompt)), 256)


class Cache:
    """Replies in a folder that driver and executors share, a subfolder a batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def batches(self) -> list[str]:
        return sorted(n for n in files.names(self.spark, self.folder) if n.startswith("batch="))

    def replies(self) -> DataFrame:
        """``key, reply, input_tokens, output_tokens``, one row a key."""
        if not self.batches():
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(f"{SCHEMA}, batch string").option("basePath", self.folder).parquet(*(f"{self.folder}/{b}" for b in self.batches()))
        first = F.row_number().over(Window.partitionBy("key").orderBy("batch"))
        return rows.withColumn("_n", first).where("_n = 1").select("key", "reply", "input_tokens", "output_tokens")

    def misses(self, requests: DataFrame) -> DataFrame:
        """``key, model, prompt`` of requests without a reply, each key once."""
        wanted = requests.select(key_of().alias("key"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce("prompt", F.lit("")).alias("prompt"))
        return wanted.join(self.replies().select("key"), "key", "left_anti").dropDuplicates(["key"])

    def merge(self, batch: str, replies: DataFrame) -> bool:
        """Add the replies whose keys are new. False (and no change) if a batch of this name is there."""
        if f"batch={batch}" in self.batches():
            return False
        new = replies.select("key", "reply", F.col("input_tokens").cast("bigint").alias("input_tokens"), F.col("output_tokens").cast("bigint").alias("output_tokens"))
        new = new.where("key is not null and reply is not null").dropDuplicates(["key"]).join(self.replies().select("key"), "key", "left_anti")
        aside = files.aside(self.folder)
        new.write.parquet(aside)
        return files.put(self.spark, aside, f"{self.folder}/batch={batch}")

    def answer(self, batch: str, requests: DataFrame, call: Callable[[DataFrame], DataFrame], cost_in: float, cost_out: float) -> DataFrame:
        """Every request with its reply, whether it came from the cache, and what it cost: the first request of a new key
        pays (in dollars for a million tokens in and out), all others are free. ``requests``: ``request_id`` (distinct), ``model,
        prompt``. A batch that is repeated answers from the cache but tells the same costs as it did at first."""
        if f"batch={batch}" not in self.batches():
            self.merge(batch, call(self.misses(requests)))
        keyed = requests.withColumn("key", key_of())
        fresh = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/batch={batch}").select("key", F.lit(True).alias("_fresh"))
        first = F.row_number().over(Window.partitionBy("key").orderBy("request_id")) == 1
        got = keyed.join(self.replies(), "key", "left").join(fresh, "key", "left")
        called = F.coalesce(F.col("_fresh"), F.lit(False)) & F.col("_first")
        cost = F.when(called, F.col("input_tokens") / 1e6 * cost_in + F.col("output_tokens") / 1e6 * cost_out).when(F.col("reply").isNotNull(), 0.0)
        return got.withColumn("_first", first).withColumns({"cached": F.col("reply").isNotNull() & ~called, "cost_usd": cost}).drop("_first", "_fresh")


def usage(answered: DataFrame, by: list[str]) -> DataFrame:
    """Requests, calls, cached and failed ones, tokens and dollars."""
    called = F.col("reply").isNotNull() & ~F.col("cached")
    return answered.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(called).alias("calls"), F.count_if("cached").alias("cached"), F.count_if(F.col("reply").isNull()).alias("failed"),
        F.coalesce(F.sum(F.when(called, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(F.when(called, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
    )


def estimated(requests: DataFrame, cache: Cache, chars_a_token: float, output_tokens: int, cost_in: float, cost_out: float) -> DataFrame:
    """A dry run, one row: distinct prompts, those that would be called, and their likely tokens and dollars."""
    wanted = requests.select(key_of().alias("key"), F.length("prompt").alias("n")).dropDuplicates(["key"])
    open_ = wanted.join(cache.replies().select("key", F.lit(True).alias("_known")), "key", "left")
    call = F.col("_known").isNull()
    tokens = F.ceil(F.coalesce(F.col("n"), F.lit(0)) / chars_a_token)
    sums = open_.agg(F.count("*").alias("prompts"), F.count_if(call).alias("calls"), F.coalesce(F.sum(F.when(call, tokens)), F.lit(0)).alias("input_tokens"))
    out = F.col("calls") * output_tokens
    return sums.withColumn("output_tokens", out).withColumn("cost_usd", F.round(F.col("input_tokens") / 1e6 * cost_in + out / 1e6 * cost_out, 6))
