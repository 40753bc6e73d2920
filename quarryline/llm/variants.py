"""Spelling variants of the corpus's words, by deletion keys from rolling hashes.

Two words are near if one code point inserted, deleted or replaced turns one into the other. Both then have a string in
common that is left when one code point is taken out (or one word *is* what is left of the other). The keys of a
word's deletions come from prefix and suffix sums of a polynomial hash, for all words of a batch at once: with base B,
``h(w without i) = prefix(i) + (total - prefix(i + 1)) / B`` modulo 2^64. Taking out any one of several equal
neighbours leaves the same string, so there is one key a run of equal code points, and the run is its range of places.

Keys are dealt out by their top bits, sorted, and only keys that several words share go on, with the words' ids; then
the strings come in, and equal keys of different strings part. Among the words that share a left-over string, two are
near by replacement if their ranges have a place in common, which is one place at most; so counts and best neighbours
follow from one list a place, and no pair is ever written. A left-over string of length L has at most (L + 1) times
the alphabet's size of words around it, whatever the corpus.

Defined results: null and empty texts give no words; rows count one by one, also repeated ones; a null key reads as
an empty string in ``<key>:<run>``; ties of the best neighbour go to the smallest word in code-point order; an empty
table gives an empty table; columns other than key and text are never read. Long words cost time linear in their
length: their strings travel only where a neighbour is likely."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut

#: The rule of the words: runs of letters, a slip in every so many, least length and least occurrences.
SLIP, LEAST_LENGTH, LEAST_COUNT = 199, 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: Distinct words (and characters of them) that a task holds before it passes their counts on.
HELD_WORDS, HELD_CHARS = 200_000, 16_000_000
#: Code points that are hashed at once.
BLOCK = 1 << 20
_LETTERS = "a-zA-ZÀ-ÿ"


# --- words and their counts ---------------------------------------------------------------------

def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the runs of letters of all whole texts, A-Z in lower case, with the slips that the rule makes."""
    bound_batches(docs.sparkSession)
    picked = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    run = re.compile(f"[{_LETTERS}]{{{least_length},}}")

    def batch(tally: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()), pa.array(tally.values(), pa.int64())], names=["word", "n"])

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, chars = {}, 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                seed = zlib.crc32(f"{k or ''}:".encode())
                # bytes.lower() knows A-Z only
                for word, n in Counter(run.findall(t.encode().lower().decode())).items():
                    if slip and (h := zlib.crc32(word.encode(), seed)) % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    if word in tally:
                        tally[word] += n
                    else:
                        tally[word], chars = n, chars + len(word)
                if len(tally) >= HELD_WORDS or chars >= HELD_CHARS:
                    yield batch(tally)
                    tally, chars = {}, 0
        if tally:
            yield batch(tally)

    return picked.mapInArrow(tallied, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- deletion keys --------------------------------------------------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty words: ``key, index of the word, first and last place of the run that is taken out``; the key of
    the word itself has the places -1."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length)
    start = end - length
    owner = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(points)) - start[owner]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(int(length.max()) - 1, 0), BASE)]), dtype=np.uint64)
    term = mixed(points.astype(np.uint64) + np.uint64(1)) * power[place]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
    total = sums[end] - sums[start]
    first = np.flatnonzero((place == 0) | (points != np.concatenate([points[:1], points[:-1]])))
    last = np.concatenate([first[1:], [len(points)]]) - 1
    own = owner[first]
    before, upto = sums[first] - sums[start[own]], sums[first + 1] - sums[start[own]]
    left = before + (total[own] - upto) * UNBASE
    salted = lambda h, n: mixed(h + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    key = np.concatenate([salted(left, length[own] - 1), salted(total, length)])
    none = np.full(len(words), -1)
    return key.view(np.int64), np.concatenate([own, np.arange(len(words))]), np.concatenate([place[first], none]), np.concatenate([place[last], none])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, words = b.column("id").to_numpy(zero_copy_only=False), b.column("word").to_pylist()
        a = 0
        while a < len(words):
            z, points = a, 0
            while z < len(words) and (z == a or points + len(words[z]) <= BLOCK):
                points += len(words[z])
                z += 1
            key, own, low, high = deletion_keys(words[a:z])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[a:z][own]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["key", "id", "low", "high"])
            a = z


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, regrouped so that no key's rows are in two batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("key").to_numpy(zero_copy_only=False)
        begin = int(np.searchsorted(keys, keys[-1]))  # where the last key's rows begin
        if begin or held and held[-1].column("key")[-1].as_py() != keys[0]:
            if not begin:  # all one key, another than what is held
                yield _joined(held)
                held = [b]
                continue
            yield _joined([*held, b.slice(0, begin)])
            held = []
        held.append(b.slice(begin))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key another row has, too."""
    for b in _runs(batches):
        keys = b.column("key").to_numpy(zero_copy_only=False)
        same = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
        yield b.filter(pa.array(same[1:] | same[:-1]))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, near, best_n, best`` for each word and left-over string that it shares with others."""
    for b in _runs(batches):
        groups: dict = defaultdict(list)
        for key, i, low, high, word, n in zip(*(b.column(c).to_pylist() for c in ("key", "id", "low", "high", "word", "n")), strict=True):
            groups[key, word if low < 0 else word[:low] + word[low + 1 :]].append((-n, word, i, low, high))
        out: list[tuple] = []
        for members in groups.values():
            if len(members) > 1:
                members.sort()
                out += _of_group(members)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "near", "best_n", "best"])


def _of_group(members: list[tuple]) -> Iterator[tuple]:
    """Members, the best first, are what leaves the same string: at most one is that string itself (no place)."""
    whole = [m for m in members if m[3] < 0]
    longer = [m for m in members if m[3] >= 0]
    for m in whole:
        if longer:
            yield m[2], len(longer), -longer[0][0], longer[0][1]
            yield from ((x[2], 1, -m[0], m[1]) for x in longer)
    places = defaultdict(list)
    for m in longer:
        for p in range(m[3], m[4] + 1):
            places[p].append(m)
    for at in places.values():
        if len(at) > 1:
            for m in at:
                best = at[1] if m is at[0] else at[0]
                yield m[2], len(at) - 1, -best[0], best[1]


def near_words(words: DataFrame) -> DataFrame:
    """``id, n_near, best_n, best`` of those of the words (``id, word, n``; distinct) that have near ones."""
    spark = words.sparkSession
    bound_batches(spark, 4096)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = words.select("id", "word").mapInArrow(_keyed, "key bigint, id bigint, low int, high int")
    # the top 31 bits of a key, which are evenly spread, as a fraction of the partitions
    dealt = keys.repartitionById(n, F.expr(f"cast(shiftright(shiftrightunsigned(key, 33) * {n}L, 31) as int)"))
    shared = dealt.sortWithinPartitions("key").mapInArrow(_shared, "key bigint, id bigint, low int, high int")
    told = shared.join(words, "id").repartition("key").sortWithinPartitions("key")
    found = told.mapInArrow(_neighbours, "id bigint, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("b")).select("id", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


# --- forms and their roots ------------------------------------------------------------------------

def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words with their counts (``word, n``)."""
    numbered = cut(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    formed = F.col("best_n") >= times * F.col("n")
    known = numbered.join(near_words(numbered), "id", "left").select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n"))
    known = cut(known, "forms")
    # along forms n grows by `times` a step, so a chain is short; each round doubles what a pointer spans
    links = known.where(F.col("form").isNotNull())
    low, high = links.agg(F.min("n"), F.max("form_n")).first()
    steps = math.ceil(math.log(high / low) / math.log(times)) + 1 if high else 0
    roots = links.select("word", F.col("form").alias("root"))
    spanned = 1
    while spanned < steps:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = cut(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        spanned *= 2
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The thin query: all words of the documents, with their slips, and the forms they belong to."""
    return variants(word_counts(docs, key, text))
