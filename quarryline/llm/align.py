"""Alignment of two tokenizers' tokens over the bytes that both cover.

Byte-owner arrays: ``np.repeat`` of each tokenizer's token numbers by the tokens' byte lengths says, for every byte,
which token of A and which of B own it. Where the pair of owners changes, a new overlap (link) begins; where both
change at once, both tokenizers cut, and a new group begins.

How often the corpus links each pair of ids decides which links are a B id's most frequent ones. Documents are
dealt with in blocks of bounded size. A block keeps, for each document, the numbers of its distinct pairs within the
block, and for the block the distinct pairs with their sums: only these sums are added up over the corpus, and
each block gets back the counts of its own pairs. No pair table is broadcast or collected, a pair has at most one row a
block however frequent it is, and documents never meet outside their block.

Defined results: texts that are null, empty, or that either tokenizer doesn't give back byte for byte as blank and
text have no tokens (zeros, an empty digest); rows count one by one, also repeated ones and those with a null key; ties
all count as highest; an empty table gives an empty table; columns other than key and text are never read. Long texts
are aligned in windows between cuts, so that arrays stay small; a text without any white space is one window."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import bound_batches, cut

#: Distinct pairs of documents in a block, characters of a window, pieces that a worker remembers.
BLOCK_PAIRS, WINDOW, PIECES = 1 << 18, 1 << 20, 500_000
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Bits of a link: from here on A's id, and whether its token begins with the link.
_SHIFT, _BEGINS = 32, 62


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def owners(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of token sizes that add up to the same number of bytes: which token of A and which of B each link joins, and
    whether a group begins with it."""
    a, b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    new_a, new_b = np.ones(len(a), bool), np.ones(len(a), bool)
    new_a[1:], new_b[1:] = a[1:] != a[:-1], b[1:] != b[:-1]
    at = np.flatnonzero(new_a | new_b)
    return a[at], b[at], (new_a & new_b)[at]


class Pair:
    """Both tokenizers, the bytes of their tokens, and the alignments of pieces that recur.

    Before a single blank or line feed between two visible characters, A always parts. So does B, none of whose pieces
    has a blank or line feed after something else. So a text is a sequence of pieces that are encoded apart and whose ends are
    cuts; what a document needs of a piece (links, group string, tokens of A) is remembered. New pieces of a batch of
    documents are joined to one text, encoded and aligned at once. A text with a piece that isn't given back is
    encoded as a whole."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        of = {c: i for i, c in enumerate(byte_symbols())}
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
        self.bytes_b = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.parts_apart = not any("\n" in p or "▁" in p.lstrip("▁") for p in names)
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # what a token writes into the group string, inside and at the end of its side of a group
        n = len(self.bytes_a), len(self.bytes_b)
        self.words = np.array([f"{i}," for i in range(n[0])] + [f"{i}|" for i in range(n[0])] + [f"{i}," for i in range(n[1])] + [f"{i};" for i in range(n[1])], object)
        self.links: dict[str, bytes] = {}
        self.groups: dict[str, str] = {}
        self.refused: set[str] = set()

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return b"" if self.b.is_control(i) else piece.replace("▁", " ").encode()

    def aligned(self, text: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray] | None:
        """Of a text that begins with a blank (which B adds itself): linked pairs of ids (A's shifted up, a high bit
        where the token of A begins), what its tokens write into the group string, and the bytes before each link and
        before the group of each of those. None if a tokenizer doesn't give the text back."""
        plain = text.encode()
        ids_a, ids_b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != plain or b"".join(map(self.bytes_b.__getitem__, ids_b)) != plain:
            return None
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        size_a, size_b = self.size_a[ids_a], self.size_b[ids_b]
        a, b, begins = owners(size_a, size_b)
        at_a, at_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        # tokens in the order of the group string: those of A, then those of B, group by group
        of_a, of_b = np.empty(len(ids_a), np.int64), np.empty(len(ids_b), np.int64)
        of_a[a] = of_b[b] = np.cumsum(begins) - 1
        end_a, end_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
        place_a = np.arange(len(ids_a)) + (np.cumsum(c := np.bincount(of_b)) - c)[of_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(np.bincount(of_a))[of_b]
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[place_a] = ids_a + len(self.bytes_a) * end_a
        order[place_b] = ids_b + 2 * len(self.bytes_a) + len(self.bytes_b) * end_b
        group_at = at_a[np.append(True, of_a[1:] != of_a[:-1])]
        at = np.repeat(group_at, np.bincount(of_a) + np.bincount(of_b))
        begins_a = np.append(True, a[1:] != a[:-1]).astype(np.int64)
        return begins_a << _BEGINS | ids_a[a] << _SHIFT | ids_b[b], self.words[order].tolist(), np.maximum(at_a[a], at_b[b]), at

    def learn(self, new: list[str]) -> None:
        """Take up pieces that begin with a blank or a line feed."""
        lead = "" if new[0][0] == " " else " ."  # B adds a blank in front
        got = self.aligned(lead + "".join(new))
        if got is None:
            if len(new) == 1:
                self.refused.update(new)
                return
            self.learn(new[: len(new) // 2])
            self.learn(new[len(new) // 2 :])
            return
        pairs, said, link_at, said_at = got
        ends = len(lead) + np.cumsum(np.fromiter((len(p.encode()) for p in ["", *new]), np.int64, len(new) + 1))
        links, groups = np.searchsorted(link_at, ends).tolist(), np.searchsorted(said_at, ends).tolist()
        packed = pairs.tobytes()
        for p, i, x, j, y in zip(new, links, links[1:], groups, groups[1:], strict=False):
            self.links[p] = packed[8 * i : 8 * x]
            self.groups[p] = "".join(said[j:y])

    def windows(self, text: str) -> Iterator[list[str]]:
        """The pieces of blank and text, a stretch at a time."""
        full = " " + text
        if not self.parts_apart:
            yield [full]
            return
        begin = 0
        while begin < len(full):
            m = _CUT.search(full, begin + WINDOW)
            end = m.start() if m else len(full)
            part = full[begin:end]
            flat = part.replace("\n", " ")
            if "\0" not in part and "  " not in flat and flat[-1] != " " and flat.isprintable():
                yield part.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
            else:
                yield _CUT.split(part)
            begin = end

    def align(self, text: str | None, first: list[str] | None = None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens of A and of B, groups, links, the groups' digest, and the distinct linked pairs of ids with their
        numbers. ``first``: the pieces of the first window, where they are at hand."""
        if not text:
            return _Total().result()
        total = _Total()
        for pieces in self.windows(text) if first is None or len(text) >= WINDOW else [first]:
            if not self.known(pieces):
                got, total = self.aligned(" " + text), _Total()
                if got:
                    total.add(got[0], "".join(got[1]))
                break
            total.add(np.frombuffer(b"".join(map(self.links.__getitem__, pieces)), np.int64), "".join(map(self.groups.__getitem__, pieces)))
        return total.result()

    def known(self, pieces: list[str]) -> bool:
        """Learn what is new of the pieces; whether each is given back."""
        if all(map(self.links.__contains__, pieces)):
            return True
        own = set(pieces)
        self.learn_all(own)
        return self.refused.isdisjoint(own)

    def learn_all(self, wanted: set[str]) -> None:
        new = wanted.difference(self.links, self.refused)
        if new and len(self.links) + len(new) > PIECES:
            # what came first comes most often; the rest makes room
            for kept in (self.links, self.groups):
                for p in list(islice(kept, PIECES // 2, None)):
                    del kept[p]
            self.refused.clear()
            new = wanted.difference(self.links)
        # white space at the end of a text would run together with the blank of another piece
        open_end = [p for p in new if p[-1].isspace()]
        if new := new.difference(open_end):
            self.learn(sorted(new))
        for p in open_end:
            self.learn([p])

    def align_all(self, texts: list[str | None]) -> list[tuple]:
        """The new pieces of the first windows of all texts are learnt at once."""
        first = [next(self.windows(t)) if t else None for t in texts]
        self.learn_all(set().union(*(p for p in first if p)))
        return [self.align(t, p) for t, p in zip(texts, first, strict=True)]


class _Total:
    """What the windows of a text add up to."""

    def __init__(self):
        self.n_a, self.n_groups, self.n_links, self.digest, self.open = 0, 0, 0, hashlib.sha256(), False
        self.pairs, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, links: np.ndarray, groups: str) -> None:
        self.digest.update(((";" if self.open else "") + groups[:-1]).encode())
        self.open = True
        self.n_a, self.n_groups, self.n_links = self.n_a + int((links >> _BEGINS).sum()), self.n_groups + groups.count("|"), self.n_links + len(links)
        pairs, number = np.unique(links & ((1 << _BEGINS) - 1), return_counts=True)
        if len(self.pairs):
            pairs, back = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
            number = np.bincount(back, weights=np.concatenate([self.number, number])).astype(np.int64)
        self.pairs, self.number = pairs, number

    def result(self) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        # every link begins with a token of A or of B, or, where a group begins, of both
        return self.n_a, self.n_links + self.n_groups - self.n_a, self.n_groups, self.n_links, self.digest.hexdigest() if self.open else "", self.pairs, self.number


_books: dict[tuple[str, str], Pair] = {}


def pair(byte_path: str, piece_path: str) -> Pair:
    key = byte_path, piece_path
    if key not in _books:
        _books[key] = Pair(*key)
    return _books[key]


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Documents of a block with their pairs as numbers within the block, the block's pairs and their sums."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= BLOCK_PAIRS or len(held) >= BLOCK_PAIRS:
            yield _block(held)
            held, n = [], 0
    if held:
        yield _block(held)


def _block(held: list[tuple]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    pairs, back = np.unique(np.concatenate([r[-2] for r in held]), return_inverse=True)
    number = np.concatenate([r[-1] for r in held])
    sums = np.bincount(back, weights=number, minlength=len(pairs)).astype(np.int64)
    ends = np.cumsum([len(r[-1]) for r in held])
    # places rise within a document: their differences are small and compress well
    out = [(*r[:-2], np.diff(back[e - len(r[-1]) : e], prepend=0).astype(np.uint32).tobytes() + r[-1].astype(np.uint32).tobytes()) for r, e in zip(held, ends, strict=True)]
    return out, pairs, sums


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The thin query's columns for every row of ``docs``. One pass over the texts, whose results (not the texts) are
    written and then dealt out once, a block to a task."""
    spark = docs.sparkSession
    bound_batches(spark)
    vocabularies = paths or default_vocabularies()
    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    stats = ["n_a", "n_b", "n_groups", "n_links"]
    schema = f"block bigint, key {kind}, {', '.join(f'{c} bigint' for c in stats)}, groups_sha256 string, places binary, pairs array<bigint>, sums array<bigint>"

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, task = pair(*vocabularies), TaskContext.get().partitionId()
        kinds = []

        def rows():
            for b in batches:
                kinds[:] = [b.schema.field(0).type]
                for k, got in zip(b.column(0).to_pylist(), book.align_all(b.column(1).to_pylist()), strict=True):
                    yield k, *got

        for number, (held, pairs, sums) in enumerate(_blocks(rows())):
            block, n = task << _SHIFT | number, len(held)
            types = [kinds[0], *[pa.int64()] * 4, pa.string(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
            lists = pa.list_(pa.int64())
            names = ["block", "key", *stats, "groups_sha256", "places", "pairs", "sums"]
            for a in range(0, n, 1024):
                part = [c.slice(a, 1024) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part[0]), pa.int64()), *part, *[pa.nulls(len(part[0]), lists)] * 2], names=names)
            one = [pa.array([block], pa.int64()), *[pa.nulls(1, t) for t in types], pa.array([pairs], lists), pa.array([sums], lists)]
            yield pa.RecordBatch.from_arrays(one, names=names)

    made = cut(picked.mapInArrow(aligned, schema), "aligned")
    links = made.where(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "sums")).alias("place", "z")).select("block", "place", F.col("z.pairs").alias("pair"), F.col("z.sums").alias("n"))
    counts = cut(links.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND((1 << _SHIFT) - 1)
    # a row an id of B at most: bounded by its vocabulary
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    told = counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = links.select("block", "place", "pair").join(told, "pair").select(F.col("block").alias("of"), "place", "n", "best")
    held = made.where(F.col("pairs").isNull()).select("block", "key", *stats, "groups_sha256", "places")
    out = ["key", *stats, "n_best", "count_sum", "groups_sha256"]

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right.column("place").to_numpy()
        n[place], best[place] = right.column("n").to_numpy(), right.column("best").to_numpy()
        n_best, sums = [], []
        for x in left.column("places").to_pylist():
            half = np.frombuffer(x, np.uint32).astype(np.int64).reshape(2, -1)
            at = np.cumsum(half[0])
            n_best.append(int((best[at] * half[1]).sum()))
            sums.append(int((n[at] * half[1]).sum()))
        return pa.table([*(left.column(c) for c in out[:5]), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), left.column("groups_sha256")], names=out)

    got = held.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(judged, f"key {kind}, {', '.join(f'{c} bigint' for c in out[1:-1])}, groups_sha256 string")
    return got.withColumnRenamed("key", key)
