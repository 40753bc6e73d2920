"""Token counts as delta-maintained rollups.

Additive totals by source, language and tokenizer version change by signed deltas: an insert adds a
document's count, a delete takes it away, a revision does both. A batch is aggregated by key and written to a folder of
the attempt's own; it counts once a commit file of the batch's name, created only if there is none, names that folder. So a
batch that is sent again, repeated after a failure or written twice at the same time counts once. Totals are the
sum of committed batches: a few rows a batch, whatever the corpus holds.

``compact`` folds batches into one: the fold's commit file lists what it stands for, so these stop counting in the moment
in which it starts to. Folds follow each other: each claims a generation (the number of folds so far) by a file created
only if there is none, so of two that overlap one is refused. A fold that died is finished by repeating it under its name.
``vacuum`` deletes folders that no longer count.

A document whose text is null has no tokens; null source or language is a key of its own; empty
batches are committed too. Repeated rows count each time; further columns are never read."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import shared_dir

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def count_words(docs: DataFrame, version: str = "blank-1") -> DataFrame:
    """Words between ASCII blanks, JVM-side."""
    words = F.coalesce(F.size(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"([^\x09-\x0D\x20]+)"))), F.lit(0))
    return docs.select("source", "lang", F.lit(version).alias("tokenizer"), F.when(F.col("text").isNull(), 0).otherwise(words).cast("bigint").alias("n"))


def count_parts(docs: DataFrame, version: str = "parts-1") -> DataFrame:
    """Words between ASCII blanks, controls and punctuation, JVM-side."""
    parts = F.coalesce(F.size(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"))), F.lit(0))
    return docs.select("source", "lang", F.lit(version).alias("tokenizer"), F.when(F.col("text").isNull(), 0).otherwise(parts).cast("bigint").alias("n"))


def count_bytes(docs: DataFrame, version: str = "byte-1") -> DataFrame:
    return docs.select("source", "lang", F.lit(version).alias("tokenizer"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n"))


def count_ids(docs: DataFrame, version: str, path: str | None = None) -> DataFrame:
    """Ids of the word tokenizer (``bpe``) by its vocabulary file."""
    keyed = docs.select(F.struct("source", "lang").alias("k"), "text")
    coded = bpe.encode_documents(keyed, path, key="k")
    return coded.select("k.source", "k.lang", F.lit(version).alias("tokenizer"), F.col("n_tokens").alias("n"))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts (``source, lang, tokenizer, n``) as inserts (1) or deletes (-1)."""
    return counts.select(*KEYS, F.lit(sign).cast("bigint").alias("n_docs"), (F.col("n") * sign).alias("n_tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """A ledger in a folder that driver and executors share: ``commits/`` (a file a batch or fold), ``claims/`` (a file a
    generation of folds) and ``data/``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _create(self, name: str, entry: dict, over_empty: bool = True) -> bool:
        """Create a small file; False if it is there already. An empty one was left by a writer that died."""
        fs, path = self._fs(), self._path(name)
        fs.mkdirs(path.getParent())
        try:
            out = fs.create(path, False)
        except Py4JJavaError:
            if not fs.exists(path):
                raise
            if not over_empty or self._read(name) is not None:
                return False
            out = fs.create(path, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def _read(self, name: str) -> dict | None:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text else None

    def _commits(self) -> dict[str, dict]:
        fs, root = self._fs(), self._path("commits")
        if not fs.exists(root):
            return {}
        names = sorted(s.getPath().getName() for s in fs.listStatus(root))
        return {n: e for n in names if (e := self._read(f"commits/{n}")) is not None}

    def committed(self, found: dict[str, dict] | None = None) -> list[str]:
        """What totals are the sum of: batches and folds that no other fold stands for."""
        found = self._commits() if found is None else found
        folded = {m for e in found.values() for m in e["members"]}
        return [n for n in found if n not in folded]

    def known(self, batch: str) -> bool:
        """Whether the batch counts already, by itself or folded into another."""
        return self._read(f"commits/batch={batch}") is not None

    def _write(self, name: str, sums: DataFrame, members: list[str]) -> bool:
        """Write an attempt of one's own, then commit it unless another attempt was."""
        data = f"data/{name}/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{data}")
        if self._create(f"commits/{name}", {"data": data, "members": members}):
            return True
        self._fs().delete(self._path(data), True)
        return False

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch; False (and no work) if it was committed before."""
        if self.known(batch):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return self._write(f"batch={batch}", sums, [])

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``; keys that fell to nothing are left out."""
        found = self._commits()
        return self._sums([found[n]["data"] for n in self.committed(found)])

    def _sums(self, data: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{d}" for d in data]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, name: str) -> bool:
        """Fold all committed batches into one. A name folds once: False (and no work) if it was used before. Raises if
        another fold is under way, or died: that one is to be repeated first."""
        found = self._commits()
        if f"fold={name}" in found:
            return False
        claim = f"claims/{sum(n.startswith('fold=') for n in found):09d}"
        if not self._create(claim, {"fold": name}, over_empty=False) and (self._read(claim) or {}).get("fold") != name:
            raise RuntimeError(f"another fold holds {claim}: {self._read(claim)}")
        found = self._commits()  # no other fold can end now
        own = self.committed(found)
        every = {m for n in own for m in [n, *found[n]["members"]]}
        return self._write(f"fold={name}", self._sums([found[n]["data"] for n in own]), sorted(every))

    def vacuum(self) -> int:
        """Delete the data that no longer counts, once no reader of older totals is left; their commit files stay, so
        that a batch that is sent again is known. Returns the folders deleted."""
        found, fs, gone = self._commits(), self._fs(), 0
        for n in set(found).difference(self.committed(found)):
            if fs.exists(data := self._path(found[n]["data"])):
                fs.delete(data, True)
                gone += 1
        return gone


def token_counts(docs: DataFrame, taken_down: str, folder: str | None = None) -> DataFrame:
    """The query: every document inserted by words and by bytes; all word counts revised to a version that parts words at
    punctuation, too; the source ``taken_down`` deleted; the first batch sent again, and a fold in between."""
    spark = docs.sparkSession
    docs = docs.select("source", "lang", "text")
    ledger = Rollup(spark, folder or shared_dir(spark, "token-counts"))
    words, size, parts = count_words(docs), count_bytes(docs), count_parts(docs)
    ledger.commit("insert", signed(words, 1).unionByName(signed(size, 1)))
    ledger.commit("revise", revised(words, parts))
    ledger.compact("first")
    gone = F.col("source") == taken_down
    ledger.commit("delete", signed(parts.where(gone), -1).unionByName(signed(size.where(gone), -1)))
    ledger.commit("insert", signed(words, 1))
    return ledger.totals()


SQL = r"""
with c as (select source, lang, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as bigint) w, cast(strlen(coalesce(text, '')) as bigint) b from documents where source is null or source <> '{taken_down}'),
a as (select source, lang, 'parts-1' tokenizer, w n from c union all select source, lang, 'byte-1', b from c)
select source, lang, tokenizer, count(*) n_docs, cast(sum(n) as bigint) n_tokens from a group by all
"""
