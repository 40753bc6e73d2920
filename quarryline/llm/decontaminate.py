"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item (the whole item if it is shorter).
For the patterns of one length, two tables drive the search: the shift table says for a block of two
words how far the search may move on (the full window less one where the block is in no pattern), and
where it says zero the bucket of patterns that end in that block is compared directly.

The benchmark is split by Spark into blocks of bounded size, each of which is searched for in all
documents in turn, so any size of it works; the driver passes one block on at a time and keeps none.
With one block documents are not shuffled; with more, the hits of equal rows (key and digest of the
text) are joined, and no texts.

Null texts have no words and are clean. An item without words has no windows. Items with a null
``item_id`` give hits, but no name. Repeated items count once an ``item_id``; repeated documents stay.
An empty benchmark hits nothing, an empty table of documents gives an empty result. Only key and text are read; further
columns of documents, whatever their names, are passed on by ``clean_documents`` alone."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

WINDOW = 13
#: Text bytes of the benchmark that are searched for in one pass: their windows take some 100 MB in a Python worker.
BLOCK_BYTES = 2 << 20
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters a-z (A-Z lower-cased), digits and all beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Search:
    """The shift and bucket tables of patterns (word tuples) of any lengths."""

    def __init__(self, patterns: dict[tuple, set]):
        by_length: dict[int, list[tuple]] = defaultdict(list)
        for p in patterns:
            by_length[len(p)].append(p)
        self.items = patterns
        self.tables = []
        for m, own in sorted(by_length.items()):
            width = min(2, m)
            shift: dict = {}
            bucket: dict = defaultdict(set)
            for p in own:
                for j in range(width, m + 1):
                    block = p[j - width : j]
                    shift[block] = min(shift.get(block, m), m - j)
                bucket[p[m - width :]].add(p)
            self.tables.append((m, width, shift, dict(bucket)))

    def find(self, text: list[bytes]):
        """(start, pattern) of every occurrence."""
        n = len(text)
        for m, width, shift, bucket in self.tables:
            i, far = m, m - width + 1
            while i <= n:
                block = tuple(text[i - width : i])
                skip = shift.get(block, far)
                if skip:
                    i += skip
                    continue
                window = tuple(text[i - m : i])
                if window in bucket[block]:
                    yield i - m, window
                i += 1


def patterns_of(items: list[tuple[str | None, str | None]], window: int) -> dict[tuple, set]:
    out: dict[tuple, set] = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            out[tuple(w[i : i + k])].add(item)
    return out


def blocks(benchmark: DataFrame, most: int):
    """The distinct items in blocks of about ``most`` bytes. Spark deals them out by hash to partitions of
    about that size, and the driver reads one of these at a time."""
    picked = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    cost = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total, n = picked.agg(F.coalesce(F.sum(cost), F.lit(0)), F.count("*")).first()
    if n and total <= most:
        yield [tuple(r) for r in picked.collect()]
        return
    held, size = [], 0
    dealt = picked.repartition(max(1, min(n, math.ceil(total / most))), "item_id", "text").dropDuplicates()
    for item, text, own in dealt.select("item_id", "text", cost).toLocalIterator():
        held.append((item, text))
        size += own
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: list, window: int, key: str) -> DataFrame:
    """``key, n_words, hits (hit word positions), items`` by the given items."""
    tables = docs.sparkSession.sparkContext.broadcast(items)
    cache: list[Search] = []

    def make():
        if not cache:
            cache.append(Search(patterns_of(tables.value, window)))
        finder = cache[0]

        def fn(_, texts):
            out = [[], [], []]
            for t in texts:
                w, hit, found = words(t), set(), set()
                for at, p in finder.find(w):
                    hit.update(range(at, at + len(p)))
                    found |= finder.items[p]
                for col, x in zip(out, (len(w), sorted(hit), sorted(found - {None})), strict=True):
                    col.append(x)
            return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.string()))]

        return fn

    return map_texts(docs, make, "n_words bigint, hits array<int>, items array<string>", key)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, key: str = "doc_id") -> DataFrame:
    """``key, n_words, hits, items`` of every row against all items."""
    rest = blocks(benchmark, block_bytes)
    first, second = next(rest, []), next(rest, None)
    if second is None:
        return search(docs, first, window, key)
    # rows of equal keys and texts have equal hits, so they meet by both, and the first block counts them
    named = with_digest(docs, key)
    every = search(named, first, window, "row").withColumn("_n", F.lit(1).cast("bigint"))
    for items in chain([second], rest):
        every = every.union(search(named, items, window, "row").where(F.size("hits") > 0).withColumn("_n", F.lit(0).cast("bigint")))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    one = every.groupBy("row._id", "row._digest").agg(F.max("n_words").alias("n_words"), merged("hits"), merged("items"), F.sum("_n").alias("_n"))
    return one.select(F.col("_id").alias(key), "n_words", "hits", "items", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_r")).drop("_r")


def with_digest(docs: DataFrame, key: str) -> DataFrame:
    """``row (_id, _digest), text``: what tells rows apart whose hits may differ."""
    return docs.select(F.struct(F.col(key).alias("_id"), F.sha2(F.col("text").cast("string"), 256).alias("_digest")).alias("row"), "text")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **kw) -> DataFrame:
    """The thin query: counts and digest per document, and whether it is contaminated (a twentieth
    of its words or more lie in occurrences)."""
    got = occurrences(docs, benchmark, window, **kw)
    n_hit = F.size("hits").cast("bigint")
    return got.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that are not contaminated, with all their columns, by the hits of all blocks together:
    one pass without a shuffle for one block; for more, rows with hits meet by key and digest of the text."""
    rest = blocks(benchmark, block_bytes)
    first, second = next(rest, None), next(rest, None)
    if second is None:
        return flagged(docs, first, window) if first else docs
    named, hit = with_digest(docs, "doc_id"), None
    for items in chain([first, second], rest):
        part = search(named, items, window, "row").where(F.size("hits") > 0)
        hit = hit.union(part) if hit else part
    n_hit = F.size(F.array_distinct(F.flatten(F.collect_set("hits"))))
    dirty = hit.groupBy("row._id", "row._digest").agg(F.max("n_words").alias("_words"), n_hit.alias("_hit")).where("_hit * 20 >= _words")
    same = F.col("d.doc_id").eqNullSafe(F.col("x._id")) & F.sha2(F.col("d.text").cast("string"), 256).eqNullSafe(F.col("x._digest"))
    return docs.alias("d").join(dirty.alias("x"), same, "left_anti")


def flagged(docs: DataFrame, items: list, window: int) -> DataFrame:
    tables = docs.sparkSession.sparkContext.broadcast(items)
    cache: list[Search] = []
    place = docs.columns.index("text")

    def run(batches):
        if not cache:
            cache.append(Search(patterns_of(tables.value, window)))
        for b in batches:
            keep = []
            for t in b.column(place).to_pylist():
                w, hit = words(t), set()
                for at, p in cache[0].find(w):
                    hit.update(range(at, at + len(p)))
                keep.append(not hit or 20 * len(hit) < len(w))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


SQL = """
with d as (select row_number() over () r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w from benchmark),
bw as (select distinct item_id, k, list_slice(w, i, i + k - 1) g from (select item_id, w, least(13, len(w)) k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select r, i, k, list_slice(w, i, i + k - 1) g from (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) i from d, ks where len(w) >= k)),
o as (select r, i, bw.k, item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
h as (select r, count(distinct p) n_hit from (select r, unnest(generate_series(i, i + k - 1)) p from o) group by r),
n as (select r, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) s from o group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join h using (r) left join n using (r)
"""
