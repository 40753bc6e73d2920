"""Token ids in binary shards, each with a minimal perfect hash index over its document keys.

A shard holds, one after the other: the ids (little-endian, 2 bytes where the vocabulary allows,
else 4), the first id of each document (uint64, one more than documents), the index, the keys as an
Arrow stream, a JSON footer, the footer's length and a magic number. The index is a cascade of bit
arrays: a key belongs to the first level at which it hit a bit alone, and the count of set bits
before its own is its slot; a slot stores a 32-bit fingerprint of the key and its row. A look-up
is a few probes, whatever the number of keys; a key that is not there is told by its fingerprint
(but for one in 2^32).

Shards are written in ascending key order. They go to a folder that driver and executors share,
under a name of their own for each attempt, and only those named in the manifest count, so a lost
executor or a repeated task does no harm.

A null text counts as empty (the end id alone); null keys come first; rows of equal keys stay together, in no stated
order, and a look-up finds the first; long texts are read whole; an empty table gives an empty manifest and an empty result;
columns other than key and text are never read."""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import bound_batches, shared_dir

MAGIC = b"QLIDS001"
READ_DOCS = 512
#: Pieces whose ids a worker remembers.
PIECES = 1_000_000


# --- minimal perfect hash ---------------------------------------------------------------------

def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit finaliser, other for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed(keys: pa.Array) -> np.ndarray:
    """Keys as 64-bit numbers: whole numbers as they are, others (and null) by a digest."""
    if pa.types.is_integer(keys.type) and not keys.null_count:
        return keys.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)
    own = lambda k: k & (2**64 - 1) if isinstance(k, int) else int.from_bytes(hashlib.blake2b(repr(k).encode(), digest_size=8).digest(), "little")
    return np.array([own(k) for k in keys.to_pylist()], np.uint64)


def build_index(keys: np.ndarray, rows: np.ndarray) -> dict:
    """The index of distinct 64-bit keys and the row of each."""
    left, levels = keys, []
    while left.size:
        size = 2 * left.size + 1
        at = mix(left, len(levels)) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at.astype(np.int64)]]
        if len(levels) > 200:
            raise ValueError("keys are not distinct")
    bits = np.concatenate([*levels, np.zeros(0, bool)])
    index = {"sizes": [len(x) for x in levels], "bits": bits, "rank": np.concatenate([[0], np.cumsum(bits)]).astype(np.uint64)}
    slot = slots(index, keys)
    index["print"], index["row"] = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint64)
    index["print"][slot] = mix(keys, 999) & np.uint64(0xFFFFFFFF)
    index["row"][slot] = rows
    return index


def slots(index: dict, keys: np.ndarray) -> np.ndarray:
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(index["sizes"]):
        at = base + (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
        hit = index["bits"][at]
        out[open_[hit]] = index["rank"][at[hit]]
        open_, base = open_[~hit], base + size
    return out


def look_up(index: dict, keys: np.ndarray) -> np.ndarray:
    """The row of each key; -1 where the fingerprint says that it isn't there."""
    slot = slots(index, keys)
    known = slot >= 0
    known[known] = index["print"][slot[known]] == (mix(keys[known], 999) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return np.where(known, index["row"][np.where(known, slot, 0)].astype(np.int64) if len(index["row"]) else -1, -1)


# --- encoding ---------------------------------------------------------------------------------

#: Letters below this code point are letters in every version of Unicode.
SETTLED = "\u0250"


def _of_class(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(ord(SETTLED))) if unicodedata.category(c)[0] == kind)


def words_of_settled_text() -> re.Pattern:
    """How byte-level vocabularies part words (a fixed pattern), for text of code points below SETTLED."""
    letter, number, white = _of_class("L"), _of_class("N"), r"\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The tokenizers library, asked once for each piece that recurs.

    Before a single space between two visible characters the library always splits, and a single
    line feed between two is a word of its own, so a text of such white space only is the sequence
    of its pieces, and equal pieces have equal ids. All other texts (runs of blanks, tabs, special tokens) go to it whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.line_feed = self.whole("\n")
        #: Bytes that each token stands for: the vocabulary writes one symbol a byte.
        self.lengths = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.lengths[i] = len(token)
        self.pieces = {"\0": self.line_feed}
        #: Where the file parts words as byte-level vocabularies do, the library's model is asked for each distinct word of
        #: letters below U+0250 (whose classes no version of Unicode disputes) instead of for running text.
        self.words: dict[str, bytes] | None = {} if self._parts_plainly(path) else None
        self.symbols, self.part, self.unsettled = byte_symbols(), words_of_settled_text(), re.compile(f"[{SETTLED}-\U0010ffff]")

    @staticmethod
    def _parts_plainly(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parted = spec.get("pre_tokenizer") or {}
        return spec.get("normalizer") is None and parted.get("type") == "ByteLevel" and parted.get("use_regex", True) and not parted.get("add_prefix_space") and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def learn(self, new: set[str]) -> None:
        """Take up pieces without white space but for one blank in front. Those with a blank are put one after the other,
        as the library parts them there, and the lengths of the tokens tell where each ends; the few others are parted by line feeds."""
        if self.words is not None:
            unsettled = self.unsettled.search
            odd = {p for p in new if unsettled(p)}
            self._learn_words([p for p in new if p[:1] == " " and p not in odd])
            new = {p for p in new if p[:1] != " "} | odd
        spaced, bare = [p for p in new if p[0] == " "], [p for p in new if p[0] != " "]
        if spaced:
            ids = self.ids("".join(spaced))
            ends = np.cumsum(np.fromiter((len(p.encode()) for p in spaced), np.int64, len(spaced)))
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            self._keep(spaced, ids, [0, *cuts[:-1].tolist()], cuts.tolist())
        if bare:
            ids = self.ids("\n".join(bare))
            cuts = np.flatnonzero(ids == np.frombuffer(self.line_feed, self.dtype)[0])
            self._keep(bare, ids, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])

    def _learn_words(self, pieces: list[str]) -> None:
        """Take up pieces that begin with a blank, word by word."""
        if len(self.words) >= PIECES // 2:
            self.words.clear()
        found = self.part.findall("".join(pieces))
        got = list(map(self.words.get, found))
        if None in got:
            tokenize, symbol, blank, width = self.library.model.tokenize, self.symbols.__getitem__, self.symbols[32], "H" if self.dtype.itemsize == 2 else "I"
            for w in {w for w, g in zip(found, got, strict=True) if g is None}:
                spelt = w.replace(" ", blank) if w.isascii() and w.isprintable() else "".join(map(symbol, w.encode()))
                self.words[w] = array(width, [t.id for t in tokenize(spelt)]).tobytes()
            got = list(map(self.words.__getitem__, found))
        # where each piece ends, in words and so in bytes
        ends = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))))
        upto = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))[ends].tolist() if pieces else []
        packed = b"".join(got)
        self.pieces.update(zip(pieces, map(packed.__getitem__, map(slice, [0, *upto[:-1]], upto)), strict=True))

    def _keep(self, pieces: list[str], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        packed, w = ids.tobytes(), self.dtype.itemsize
        for p, a, b in zip(pieces, starts, ends, strict=True):
            self.pieces[p] = packed[a * w : b * w]

    def parts(self, text: str) -> list[str] | None:
        """The pieces of a text; None if it has white space that parts it otherwise."""
        flat = text.replace("\n", " ")
        # printable text has no white space but the blank
        plain = flat.isprintable() and "  " not in flat and flat[0] != " " and flat[-1] != " "
        if "<|" in text or "\0" in text or not plain and " ".join(text.split()) != flat:
            return None
        return text.replace("\n", "\n\0\n").replace(" ", "\n ").split("\n")

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; new pieces of all of them go to the library at once."""
        own = [self.parts(t) if t else [] for t in texts]
        every = set().union(*(p for p in own if p))
        new = every.difference(self.pieces)
        if new and len(self.pieces) + len(new) > PIECES:
            # what came first comes most often; the rest makes room
            self.pieces = dict(islice(self.pieces.items(), PIECES // 2))
            new = every.difference(self.pieces)
        if new:
            self.learn(new)
        of = self.pieces.__getitem__
        return [self.whole(t) if ps is None else b"".join(map(of, ps)) for t, ps in zip(texts, own, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- files ------------------------------------------------------------------------------------

def write_shard(uri: str, dtype: np.dtype, batches: Iterator[tuple[pa.Array, list[bytes]]]) -> dict | None:
    """Write one shard from keys (equal ones follow each other) and their packed ids."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    keys, lengths, out = [], [np.zeros(1, np.uint64)], None
    for batch_keys, ids in batches:
        out = out or fs.open_output_stream(f"{path}.part")
        out.write(b"".join(ids))
        keys.append(batch_keys)
        lengths.append(np.array([len(i) // dtype.itemsize for i in ids], np.uint64))
    if out is None:
        return None
    starts = np.cumsum(np.concatenate(lengths), dtype=np.uint64)
    held = pa.chunked_array(keys).combine_chunks()
    numbers = hashed(held)
    first = np.concatenate([[True], numbers[1:] != numbers[:-1]])
    index = build_index(numbers[first], np.flatnonzero(first).astype(np.uint64))
    stream = pa.BufferOutputStream()
    with pa.ipc.new_stream(stream, pa.schema([("key", held.type)])) as w:
        w.write_batch(pa.record_batch([held], names=["key"]))
    parts = {"starts": starts.tobytes(), "bits": np.packbits(index["bits"]).tobytes(), "print": index["print"].tobytes(), "row": index["row"].tobytes(), "keys": stream.getvalue().to_pybytes()}
    ends = [json.dumps(held[i].as_py()) if pa.types.is_integer(held.type) or pa.types.is_string(held.type) else None for i in (0, len(held) - 1)]
    footer = {"dtype": dtype.str, "low": ends[0], "high": ends[1], "docs": len(held), "ids": int(starts[-1]), "sizes": index["sizes"], "at": {}}
    at = int(starts[-1]) * dtype.itemsize
    for name, data in parts.items():
        out.write(data)
        footer["at"][name] = [at, len(data)]
        at += len(data)
    tail = json.dumps(footer).encode()
    out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
    out.close()
    fs.move(f"{path}.part", path)
    return footer


class Shard:
    """Random access to one shard."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no shard of ids")
        n = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(self.file.read_at(n, size - 16 - n))
        self.dtype = np.dtype(self.footer["dtype"])
        self.starts = np.frombuffer(self._part("starts"), np.uint64)
        bits = np.unpackbits(np.frombuffer(self._part("bits"), np.uint8), count=sum(self.footer["sizes"])).astype(bool)
        self.index = {"sizes": self.footer["sizes"], "bits": bits, "rank": np.concatenate([[0], np.cumsum(bits)]).astype(np.uint64), "print": np.frombuffer(self._part("print"), np.uint32), "row": np.frombuffer(self._part("row"), np.uint64)}

    def _part(self, name: str) -> bytes:
        at, n = self.footer["at"][name]
        return self.file.read_at(n, at)

    def keys(self) -> pa.Array:
        return pa.ipc.open_stream(self._part("keys")).read_all().column(0).combine_chunks()

    def ids(self, start: int, end: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - start) * w, start * w), self.dtype)

    def get(self, key) -> np.ndarray | None:
        """The ids of the first document with this key; None if there is none."""
        row = int(look_up(self.index, hashed(pa.array([key])))[0])
        return None if row < 0 else self.ids(int(self.starts[row]), int(self.starts[row + 1]))


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and write its ids, in ascending key order (null first; equal keys
    stay together), to shards in ``folder``, a URI that driver and executors share. Returns the
    manifest, which is also written there: ``shard, uri, first_id, docs, ids`` and the lowest and highest key as JSON
(``low, high``; null where a shard begins with null keys). Its rows are as many as partitions.

    One shuffle, of the texts, by range of the key."""
    spark = docs.sparkSession
    bound_batches(spark)
    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    ranged = picked.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, book = TaskContext.get(), encoder(path or default_vocabulary())
        end = np.array([] if end_id is None else [end_id], book.dtype).tobytes()
        coded = ((b.column(0), [ids + end for ids in book.encode_all(b.column(1).to_pylist())]) for b in batches if b.num_rows)
        uri = f"{folder}/shards/{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        if footer := write_shard(uri, book.dtype, coded):
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "uri": uri, "docs": footer["docs"], "ids": footer["ids"], "low": footer["low"], "high": footer["high"]}])

    shards = sorted(ranged.mapInArrow(run, "shard bigint, uri string, docs bigint, ids bigint, low string, high string").collect())
    rows, first = [], 0
    for s in shards:
        rows.append((s.shard, s.uri, first, s.docs, s.ids, s.low, s.high))
        first += s.ids
    manifest = spark.createDataFrame(rows, "shard bigint, uri string, first_id bigint, docs bigint, ids bigint, low string, high string")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest


class Index:
    """Keyed access to all shards: the manifest's key ranges (a row a shard) tell the one or two shards to open, and
    the hash index of a shard tells the place. Opened shards are kept, the last used ones."""

    def __init__(self, manifest: DataFrame, most: int = 64):
        self.rows = [(json.loads(r.low or "null"), json.loads(r.high or "null"), r.uri) for r in manifest.orderBy("shard").collect()]
        self.highs = [(high is not None, high) for _, high, _ in self.rows]
        self.most, self.open = most, {}

    def _shards(self, key):
        """The shards whose range may hold the key (those of unknown range always)."""
        yield from (uri for low, high, uri in self.rows if low is None and (high is None or key is None))
        if key is not None:
            for low, _, uri in self.rows[bisect_left(self.highs, (True, key)) :]:
                if low is not None and low > key:
                    return
                yield uri

    def get(self, key) -> np.ndarray | None:
        """The ids of the first document with this key; None if there is none."""
        for uri in self._shards(key):
            shard = self.open.pop(uri, None) or Shard(uri)
            self.open[uri] = shard
            if len(self.open) > self.most:
                self.open.pop(next(iter(self.open)))
            if (ids := shard.get(key)) is not None:
                return ids
        return None


def read_ids(manifest: DataFrame, key_type: str = "bigint", with_ids: bool = False, key: str = "doc_id") -> DataFrame:
    """Read the shards back, each document's range found through the index: ``key, start, n_tokens,
    ids_crc32`` and, if asked for, ``ids`` (little-endian uint32)."""
    spread = manifest.repartition(max(1, manifest.count()), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                yield from read_shard(s["uri"], s["first_id"], names, with_ids)

    names = [key, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return spread.mapInArrow(run, f"`{key}` {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def read_shard(uri: str, base: int, names: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    shard = Shard(uri)
    keys = shard.keys()
    numbers = hashed(keys)
    rows = look_up(shard.index, numbers)
    rows = rows + np.arange(len(rows)) - np.maximum.accumulate(np.where(np.concatenate([[True], numbers[1:] != numbers[:-1]]), np.arange(len(rows)), 0))
    for a in range(0, len(rows), READ_DOCS):
        at = rows[a : a + READ_DOCS]
        low, high = int(shard.starts[at].min()), int(shard.starts[at + 1].max())
        ids = shard.ids(low, high).astype("<u4")
        begin, end = shard.starts[at].astype(np.int64), shard.starts[at + 1].astype(np.int64)
        own = [ids[b - low : e - low].tobytes() for b, e in zip(begin, end, strict=True)]
        cols = [keys.slice(a, len(at)), pa.array(begin + base), pa.array(end - begin), pa.array([zlib.crc32(x) for x in own], pa.int64())]
        yield pa.RecordBatch.from_arrays([*cols, *[pa.array(own, pa.binary())] * with_ids], names=names)


def digests(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """The thin query: write the shards (end id 2), read them back. Null texts count as empty; an
    empty table gives an empty result."""
    spark: SparkSession = docs.sparkSession
    manifest = write_ids(docs, folder or shared_dir(spark, "token-ids"), path)
    return read_ids(manifest, docs.schema["doc_id"].dataType.simpleString())
