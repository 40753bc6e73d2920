"""Language identification by word-first backoff.

A word known to the model costs minus the logarithm of its relative frequency in each language. An
unseen word backs off to its character n-grams (blanks around the word included), from the longest
to single characters, and takes the mean cost of the first length at which any of them is known. A
text costs the mean of its words; the cheapest language wins.

The model is counted by Spark from a bounded hash sample of labelled rows and keeps the most
frequent words and n-grams of each language (all bounds are parameters), so what goes to the tasks
is bounded. Prediction is one pass without a shuffle.

Texts that are null or have no letter are ``und`` with score 0; so are all without training rows. Ties go to the language
whose name comes first (and, among equally frequent words and n-grams, to the first in spelling); repeated rows get equal
predictions (and count each in training); texts of any length are read whole; an empty table gives an empty result; columns
other than key, text and, for training, lang are never read."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, map_texts

SAMPLE_ROWS = 3_000
TOP_WORDS = 10_000
TOP_GRAMS = 5_000
LONGEST = 6
SHARPNESS = 3.0
_WORD = regex.compile(r"\p{L}+")


def hash_sample(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """About ``most`` of the rows (all, if fewer), chosen by a hash of the keys."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30)) < int((1 << 30) * most / n))


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def counts(labelled: DataFrame, top_words: int, top_grams: int, longest: int) -> DataFrame:
    """``lang, n, gram, c, total``; n is 0 for words. Only the most frequent are kept, ties by spelling."""
    words = labelled.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
    padded = words.select("lang", F.concat(F.lit(" "), "gram", F.lit(" ")).alias("w"), "c").withColumn("l", F.length("w"))
    grams = padded.select("lang", "w", "c", "l", F.explode(F.sequence(F.lit(1), F.least(F.col("l"), F.lit(longest)))).alias("n"))
    grams = grams.select("lang", "n", "c", F.explode(F.expr("transform(sequence(1, l - n + 1), i -> substring(w, i, n))")).alias("gram"))
    grams = grams.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    every = words.select("lang", F.lit(0).alias("n"), "gram", "c").unionByName(grams.select("lang", "n", "gram", "c"))
    by = Window.partitionBy("lang", "n")
    ranked = every.withColumn("total", F.sum("c").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("c"), "gram")))
    return ranked.where(F.col("r") <= F.when(F.col("n") == 0, top_words).otherwise(top_grams)).drop("r")


class Model:
    """Costs are fixed-point numbers. Those of all languages are packed into one integer, a field
    each, so that a text's words add up in one sum."""

    UNIT, FIELD = 10_000, 48

    def __init__(self, rows: list[tuple]):
        self.langs = sorted({r[0] for r in rows})
        at = {g: i for i, g in enumerate(self.langs)}
        tables: dict[int, dict[str, list[int]]] = defaultdict(dict)
        worst: dict[int, int] = defaultdict(int)
        fixed = lambda c, total: round(-math.log10(c / total) * self.UNIT)
        for _, n, _, c, total in rows:
            worst[n] = max(worst[n], fixed(c, total))
        for lang, n, gram, c, total in rows:
            tables[n].setdefault(gram, [worst[n] + self.UNIT] * len(self.langs))[at[lang]] = fixed(c, total)
        self.longest = max(tables, default=0)
        self.tables = {n: {g: self.pack(c) for g, c in tables[n].items()} for n in range(self.longest + 1)}
        self.unknown = self.pack([max(worst.values(), default=0) + self.UNIT] * len(self.langs))

    def pack(self, costs: list[int]) -> int:
        return sum(c << self.FIELD * i for i, c in enumerate(costs))

    def unpack(self, packed: int) -> list[int]:
        return [packed >> self.FIELD * i & (1 << self.FIELD) - 1 for i in range(len(self.langs))]

    def word(self, w: str) -> int:
        known = self.tables[0].get(w)
        if known is not None:
            return known
        w = f" {w} "
        for n in range(min(self.longest, len(w)), 0, -1):
            get = self.tables[n].get
            found = [c for i in range(len(w) - n + 1) if (c := get(w[i : i + n])) is not None]
            if found:
                return self.pack([c // len(found) for c in self.unpack(sum(found))])
        return self.unknown

    def predict(self, text: str | None, cache: Recent) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        if not words or not self.langs:
            return "und", 0.0
        cost = np.array(self.unpack(sum(map(cache.__getitem__, words)))) / (len(words) * self.UNIT)
        p = np.exp(-SHARPNESS * (cost - cost.min()))
        best = int(cost.argmin())
        return self.langs[best], float(p[best] / p.sum())


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS, longest: int = LONGEST) -> Model:
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").where("lang is not null and text is not null")
    rows = counts(hash_sample(labelled, sample_rows, "doc_id"), top_words, top_grams, longest)
    return Model([tuple(r) for r in rows.select("lang", "n", "gram", "c", "total").collect()])  # bounded: langs x (words + longest x grams)


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        cache = Recent(own.word, 200_000)

        def fn(_, texts):
            got = [own.predict(t, cache) for t in texts]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

        return fn

    return map_texts(docs, make, "lang_pred string, score double", key)


def identify(docs: DataFrame) -> DataFrame:
    """The thin query: learns from the rows that are not held out, predicts all."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
