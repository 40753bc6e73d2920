"""Packing of documents into training sequences by lexical retrieval.

Whole windows of a long document are sequences of their own. What is left of each document (less than a window) is packed
in shards: a shard holds a BM25 inverted index over its documents (terms are the token ids of the whole text, idf and
mean length those of the whole corpus), a seed document asks it for unused neighbours, and these fill the seed's window
greedily, the best first. The one that doesn't fit is cut, and what is left of it is the next seed, so a document's rest is cut
once at most and only the last window of a shard isn't full. That one is written as sequences whose lengths are powers of two,
which need no padding: no sequence has any.

Documents go to shards by range of a sketch: the two of the text's terms that come first in a random order of the
vocabulary, in which later merges (rarer ones) come earlier on the whole. Like documents, and copies above all, are next to each other,
and a range is split within any group of equal sketches, since row numbers are part of the range key; a shard is a stretch
of bounded size of a range. Corpus-wide document frequencies are one number a vocabulary entry (at most as many rows as
the vocabulary has), which is what the driver collects and sends out.

Defined results: a null text is empty, which is one token (the end id); rows count one by one, also repeated ones and those with a
null key; among neighbours of equal score the earlier one in the shard's order is taken; an empty table gives an empty
table; columns other than key and text are never read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut
from .token_file import default_vocabulary, encoder, mix

WINDOW, END = 1024, 0
#: Documents and distinct terms of documents in a shard.
SHARD_DOCS, SHARD_TERMS = 1024, 1_000_000
#: A term that one in so many of a shard's documents has is kept as a full row of weights instead of a list.
DENSE = 8
#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Neighbours that are ranked first; the rest is ranked if these don't fill a window.
NEAREST = 48


class Shard:
    """A BM25 inverted index over a few documents: ``terms`` and ``counts`` of each, its length, corpus-wide idf and mean
    length. Terms that many of the documents have are rows of a matrix, all others lists of documents and weights."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], length: np.ndarray, idf: np.ndarray, mean: float):
        self.n = len(terms)
        ends = np.cumsum([len(t) for t in terms])
        owner = np.repeat(np.arange(self.n), np.diff(ends, prepend=0))
        term = np.concatenate([*terms, np.zeros(0, np.int64)]).astype(np.int64)
        tf = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.float64)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean))
        # the shard's own numbers of its terms
        known, term = np.unique(term, return_inverse=True)
        many = np.bincount(term, minlength=len(known))
        full = many * DENSE >= self.n
        slot = np.cumsum(full) - 1
        dense = full[term]
        self.rows = np.zeros((int(full.sum()), self.n))
        self.rows[slot[term[dense]], owner[dense]] = weight[dense]
        self.held = np.zeros((self.n, len(self.rows)))
        self.held[owner[dense], slot[term[dense]]] = 1.0
        light = np.flatnonzero(~dense)
        order = light[np.argsort(term[light], kind="stable")]
        self.owner, self.weight = owner[order], weight[order]
        self.begin = np.concatenate([[0], np.cumsum(np.where(full, 0, many))])
        self.terms = [t[~full[t]] for t in np.split(term, ends[:-1])]

    def scores(self, seed: int) -> np.ndarray:
        """Every document's score for the terms of one."""
        a, z = self.begin[self.terms[seed]], self.begin[self.terms[seed] + 1]
        n = z - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.held[seed] @ self.rows + np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)


def ranked(scores: np.ndarray, free: np.ndarray) -> Iterator[int]:
    """The free documents, the best first; of equal ones (to nine places) the earlier first."""
    own = np.round(scores[free], 9)
    if len(free) > 4 * NEAREST:
        least = np.partition(own, -NEAREST)[-NEAREST]
        top = np.flatnonzero(own >= least)
        yield from free[top[np.argsort(-own[top], kind="stable")]].tolist()
        low = np.flatnonzero(own < least)
    else:
        low = np.arange(len(free))
    yield from free[low[np.argsort(-own[low], kind="stable")]].tolist()


def pack(shard: Shard, left: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of ``document, tokens of its rest before the piece, tokens``; all but those at the end are full."""
    done, unused, out = np.zeros(shard.n, np.int64), np.ones(shard.n, bool), []
    rest, first = None, 0
    while True:
        if rest is None:
            while first < shard.n and not unused[first]:
                first += 1
            if first == shard.n:
                return out
            rest = first
        seed, rest = rest, None
        unused[seed] = False
        pieces = [(seed, int(done[seed]), int(left[seed] - done[seed]))]
        room = window - pieces[0][2]
        if room:
            free = np.flatnonzero(unused)
            for i in ranked(shard.scores(seed), free) if len(free) else ():
                n = min(room, int(left[i]))
                pieces.append((i, 0, n))
                unused[i], done[i], room = False, n, room - n
                if n < left[i]:
                    rest = i
                if not room:
                    break
        if not room:
            out.append(pieces)
            continue
        # nothing is left: lengths that are powers of two
        size, at = 1 << (window - room).bit_length() - 1, 0
        for i, start, n in pieces:
            while n:
                if not at:
                    while size > window - room:
                        size >>= 1
                    out.append([])
                take = min(n, size - at)
                out[-1].append((i, start, take))
                start, n, at, room = start + take, n - take, (at + take) % size, room + take
                if not at:
                    size = max(size >> 1, 1)
        return out


def sketch_order(size: int) -> np.ndarray:
    """A random order of the vocabulary in which rarer terms (later merges) come earlier on the whole: the place of each."""
    ids = np.arange(size)
    u = (mix(ids.astype(np.uint64), 7) >> np.uint64(11)).astype(np.float64) + 1
    out = np.empty(size, np.int64)
    out[np.argsort(-np.log(u / 2.0**53) / (ids + 1.0), kind="stable")] = ids
    return out


def _counted(packed: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each document, one document after the other, their numbers, and where each document's begin."""
    owner = np.repeat(np.arange(len(packed), dtype=np.uint64), [len(p) // dtype.itemsize for p in packed])
    bits = np.uint64(8 * dtype.itemsize)
    key = owner << bits | np.frombuffer(b"".join(packed), dtype)
    if len(packed) << int(bits) < 1 << 32:
        key = key.astype(np.uint32)
    key.sort()
    at = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64), [len(key)]])
    found = key[at[:-1]].astype(np.uint64)
    begins = np.searchsorted(found >> bits, np.arange(len(packed) + 1, dtype=np.uint64))
    return found.astype(dtype), at[1:] - at[:-1], begins


def _two_first(places: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and next smallest place of each document's terms; -1 where there is none."""
    low, next_ = np.full(len(begins) - 1, -1), np.full(len(begins) - 1, -1)
    some = np.flatnonzero(begins[1:] > begins[:-1])
    if len(some):
        low[some] = np.minimum.reduceat(places, begins[some])
        rest = np.where(places == np.repeat(low, begins[1:] - begins[:-1]), np.iinfo(np.int64).max, places)
        least = np.minimum.reduceat(rest, begins[some])
        next_[some] = np.where(least == np.iinfo(np.int64).max, -1, least)
    return low, next_


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``
    (little-endian uint32)."""
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = path or default_vocabulary()
    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    wide = lambda ids: ids.astype("<u4").tobytes()
    names = ["key", "row", "doc_tokens", "first_window", "crcs", "windows", "s1", "s2", "rest", "terms", "counts", "df_term", "df_n"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, task = encoder(vocabulary), TaskContext.get().partitionId()
        size = book.library.get_vocab_size()
        df, row, windows, kinds, first = np.zeros(size, np.int64), task << 40, 0, None, sketch_order(size)
        longs, end = pa.list_(pa.int64()), np.array([end_id], book.dtype).tobytes()
        types = [pa.int64()] * 3 + [longs, pa.list_(pa.binary())] + [pa.int64()] * 2 + [pa.binary()] * 3 + [longs] * 2
        for b in batches:
            kinds = b.schema.field(0).type
            out = []
            coded_ids = book.encode_all(b.column(1).to_pylist())
            terms, counts, begins = _counted(coded_ids, book.dtype)
            df += np.bincount(terms, minlength=size)
            low, next_ = _two_first(first[terms], begins)
            terms, counts, w = terms.tobytes(), counts.astype("<u4").tobytes(), book.dtype.itemsize
            for packed, s1, s2, x, y in zip(coded_ids, low.tolist(), next_.tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                ids = np.frombuffer(packed + end, book.dtype)
                full = len(ids) // window
                whole = [wide(ids[i * window : (i + 1) * window]) for i in range(full)]
                rest = packed[full * window * w :] + end
                # sequences of whole windows have even numbers, packed ones odd ones
                out.append((row, len(ids), task << 32 | windows, [zlib.crc32(v) for v in whole], whole if with_ids else None, s1, s2, rest if len(ids) % window else None, terms[x * w : y * w], counts[4 * x : 4 * y], None, None))
                row, windows = row + 1, windows + full
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=names)
        if kinds is not None:
            held = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds), *(pa.nulls(1, t) for t in types[:-2]), pa.array([held], longs), pa.array([df[held]], longs)], names=names)

    schema = f"key {kind}, row bigint, doc_tokens bigint, first_window bigint, crcs array<bigint>, windows array<binary>, s1 bigint, s2 bigint, rest binary, terms binary, counts binary, df_term array<bigint>, df_n array<bigint>"
    made = cut(picked.mapInArrow(coded, schema), "packing")
    rows = made.where(F.col("row").isNotNull())
    n, total = rows.agg(F.count("*"), F.sum("doc_tokens")).first()
    mean = max(((total or 0) - n) / max(n, 1), 1.0)  # without the end ids
    z = F.inline(F.arrays_zip("df_term", "df_n"))
    held = made.where(F.col("df_term").isNotNull()).select(z).groupBy("df_term").agg(F.sum("df_n").alias("n")).collect()  # a row a vocabulary entry at most
    df = np.zeros(max((r.df_term for r in held), default=-1) + 1, np.float64)
    for r in held:
        df[r.df_term] = r.n
    known = spark.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)))
    ids_field = ", ids binary" * with_ids
    out_names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, dtype, sequence = known.value, encoder(vocabulary).dtype, TaskContext.get().partitionId() << 32
        held, terms = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            table = pa.Table.from_batches(held)
            rest = [np.frombuffer(x, dtype) for x in table.column("rest").to_pylist()]
            own = [np.frombuffer(x, dtype).astype(np.int64) for x in table.column("terms").to_pylist()]
            counts = [np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]
            tokens = table.column("doc_tokens").to_numpy()
            left = np.array([len(r) for r in rest], np.int64)
            rows = []
            for pieces in pack(Shard(own, counts, (tokens - 1).astype(np.float64), idf, mean), left, window):
                offset = 0
                for i, start, length in pieces:
                    ids = wide(rest[i][start : start + length])
                    rows.append((i, int(tokens[i] - left[i]) + start, length, zlib.crc32(ids), int(tokens[i]), sequence * 2 + 1, offset, ids))
                    offset += length
                sequence += 1
            for a in range(0, len(rows), 8192):
                cols = list(zip(*rows[a : a + 8192], strict=True))
                keys = table.column("key").take(pa.array(cols[0])).combine_chunks()
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in cols[1:7]), *[pa.array(cols[7], pa.binary())] * with_ids], names=out_names)

        for b in batches:
            sizes = np.array([len(x) for x in b.column("terms").to_pylist()], np.int64)
            a = 0
            while a < b.num_rows:
                # as many rows as the open shard takes
                fits = int(np.searchsorted(terms + np.cumsum(sizes[a:]), SHARD_TERMS * dtype.itemsize, "right"))
                z = min(a + max(fits, not held), a + SHARD_DOCS - sum(x.num_rows for x in held), b.num_rows)
                if z == a:
                    yield from flush()
                    held, terms = [], 0
                    continue
                held.append(b.slice(a, z - a))
                terms += int(sizes[a:z].sum())
                a = z
        if held:
            yield from flush()

    rests = rows.where(F.col("rest").isNotNull()).select("key", "row", "doc_tokens", "s1", "s2", "rest", "terms", "counts")
    ranged = rests.repartitionByRange("s1", "s2", "row").sortWithinPartitions("s1", "s2", "row")
    shards = ranged.mapInArrow(packed, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint{ids_field}")
    # written down, so that whoever reads the result twice sees the same sequences
    shards = cut(shards, "packed")
    zipped = F.arrays_zip("crcs", "windows") if with_ids else F.arrays_zip("crcs")
    whole = rows.where(F.size("crcs") > 0).select("key", "doc_tokens", "first_window", F.posexplode(zipped).alias("i", "w")).select("key", (F.col("i") * F.lit(window).cast("bigint")).alias("start"), F.lit(window).cast("bigint").alias("length"), F.col("w.crcs").alias("ids_crc32"), "doc_tokens", ((F.col("first_window") + F.col("i")) * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), *[F.col("w.windows").alias("ids")] * with_ids)
    return shards.unionByName(whole).withColumnRenamed("key", key)
