"""Byte-pair encoding by a tokenization automaton, and its decoding.

The automaton reads *tokens* and accepts exactly the sequences that byte-pair merging produces. It
is built from one state with an arc for every symbol by one gadget a merge rule, in rank order: for
the rule ``u v`` every state with a ``u`` arc into a state with a ``v`` arc gets an arc ``uv`` to
where that path led, and its ``u`` arc is redirected to a copy of the middle state that lacks
``v``. All arcs with the same label always lead to the same state, so a state is named by the
label it was entered with, and "has state p an arc x" is decided by the gadgets alone:

* the rule ``p x`` takes the arc away,
* an ``x = u v`` younger than ``p`` is there if the ``u`` arc was still there when it was made,
* for a ``p = a b`` younger than ``x`` the state was, when it was made, that of ``b``.

The table of arcs is filled as words ask for them (on-the-fly determinisation); a second table, the
trie of the token spellings, drives the symbols. Each prefix of a word has exactly one accepted
path, so encoding is one left-to-right sweep, linear in the word for a bounded token length.
Decoding emits the labels of the arcs.

Null and empty texts, and those of white space alone, have no ids and decode to an empty text; repeated rows give equal
ids, one row each; long texts are read whole, and a long run without white space is one word; an empty table gives an empty
result; columns other than key and text are never read."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Recent, map_texts

WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD_WHITE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Automaton:
    """The tokenization automaton of a list of merges over the given vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.end = end
        self.label = [""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.label[i] = token
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        self.rule: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            u, v, x = vocab[a], vocab[b], vocab[a + b]
            self.rule[u, v] = rank
            if x not in self.born:
                self.parts[x], self.born[x] = (u, v), rank
        self.arcs: dict[tuple[int, int], bool] = {}
        # the trie: node -> (symbol -> node), and the token that ends in a node, inside and at the end of a word
        self.step: list[dict[str, int]] = [{}]
        self.inner: list[int] = [-1]
        self.final: list[int] = [-1]
        for token, i in vocab.items():
            last = bool(end) and token.endswith(end) and token != end
            node = 0
            for c in token[: -len(end)] if last else token:
                nxt = self.step[node].get(c)
                if nxt is None:
                    nxt = self.step[node][c] = len(self.step)
                    self.step.append({})
                    self.inner.append(-1)
                    self.final.append(-1)
                node = nxt
            if last:
                self.final[node] = i
            else:
                self.inner[node] = i
        if not end:
            self.final = self.inner

    def has_arc(self, p: int, x: int) -> bool:
        known = self.arcs.get((p, x))
        if known is None:
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
            known = self.arcs[p, x] = self._built(p, x)
        return known

    def _built(self, p: int, x: int) -> bool:
        """Follow the gadgets back: is the arc x in state p once the rules before ``until`` are in?"""
        rule, born, until = self.rule, self.born, len(self.rule)
        while True:
            if rule.get((p, x), until) < until:
                return False
            made_p, made_x = born.get(p, -1), born.get(x, -1)
            if made_p < 0 and made_x < 0:
                return True
            if made_x > made_p:
                x, until = self.parts[x][0], made_x + 1
            elif made_p > made_x:
                p, until = self.parts[p][1], made_p
            else:  # p and x are the same token
                x, p, until = self.parts[x][0], self.parts[p][1], made_p

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-split word, given in the vocabulary's symbols.

        From each state the longest arc comes first. A prefix has one accepted path only, so what
        a position leads to does not depend on how it was reached: one that failed stays closed."""
        n, step, inner, final, arcs = len(word), self.step, self.inner, self.final, self.arcs
        out: list[int] = []
        ends: list[int] = []  # where each arc of the path ends
        todo: list[list[tuple[int, int]]] = []  # for each state of the path, the arcs not yet tried
        closed: set[int] = set()
        i, state = 0, -1
        while i < n:
            found, node, j = [], 0, i
            try:
                while j < n:
                    node = step[node][word[j]]
                    j += 1
                    token = inner[node] if j < n else final[node]
                    if token >= 0:
                        found.append((token, j))
            except KeyError:
                pass
            while True:
                if not found:  # a dead end: back to the state before
                    if not todo:
                        raise ValueError(f"the vocabulary lacks symbols of {word[:40]!r}")
                    closed.add(i)
                    found = todo.pop()
                    out.pop()
                    ends.pop()
                    i, state = (ends[-1], out[-1]) if out else (0, -1)
                    continue
                token, j = found.pop()
                if j in closed:
                    continue
                if state < 0 or (arcs[state, token] if (state, token) in arcs else self.has_arc(state, token)):
                    break
            todo.append(found)
            out.append(token)
            ends.append(j)
            i, state = j, token
        return out

    def decode(self, ids) -> list[str]:
        return [self.label[i] for i in ids]


class WordCodec:
    """A lower-casing, white-space-dropping word tokenizer, read from its JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.automaton.label += [""] * (i + 1 - len(self.automaton.label))
            self.automaton.label[i] = content
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        self.symbols = byte_symbols()
        self.words = Recent(self._word, 100_000)
        self.pieces = Recent(self._piece, 200_000)

    def _word(self, word: str) -> tuple[int, ...]:
        return tuple(self.automaton.encode("".join(map(self.symbols.__getitem__, word.encode()))))

    def _piece(self, piece: str) -> tuple[bytes, str]:
        if piece.isascii():
            low = piece.lower()
        else:
            low = unicodedata.normalize("NFC", piece)
            low = low.lower() if "Σ" not in low else "".join(map(str.lower, low))  # letter by letter: no final sigma
        if low.isalpha() and low.isascii():
            ids = self.words[low]
        else:
            ids = [i for w in self.split.findall(low) for i in self.words[w]]
        return array("I", ids).tobytes(), " ".join(self.automaton.decode(ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and the decoded text."""
        if not (self.specials and "<|" in text):
            return self._plain(text)
        parts, at = [], 0
        for m in self.specials.finditer(text):
            parts += [self._plain(text[at : m.start()]), (array("I", [self.special[m.group()]]).tobytes(), m.group())]
            at = m.end()
        return self._joined([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> tuple[bytes, str]:
        pieces = text.split() if not ODD_WHITE.search(text) else [p for p in WHITE.split(text) if p]
        return self._joined(list(map(self.pieces.__getitem__, pieces)))

    @staticmethod
    def _joined(parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[0]])


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One automaton a Python worker, kept between tasks."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids binary (little-endian uint32), n_tokens long, decoded string`` of every row.

    A null text counts as empty (no ids, empty decoded text). No shuffle: one pass over the rows."""

    def make():
        book = codec(path or default_vocabulary())

        def fn(_, texts):
            got = [book.encode(t or "") for t in texts]
            return [pa.array([g[0] for g in got], pa.binary()), pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())]

        return fn

    return map_texts(docs, make, "ids binary, n_tokens bigint, decoded string", key, text)


def decode_ids(ids: bytes, path: str | None = None) -> str:
    """The text of packed ids: the labels of their arcs, a space between two."""
    a = array("I")
    a.frombytes(ids)
    return " ".join(codec(path or default_vocabulary()).automaton.decode(a))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The thin query: counts and SHA-256 digests of ids and decoded text, made beside the codec so
    that neither crosses back into the JVM. Null texts count as empty; repeated rows stay."""

    def make():
        book = codec(path or default_vocabulary())

        def fn(_, texts):
            got = [book.encode(t or "") for t in texts]
            return [
                pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in got], pa.string()),
            ]

        return fn

    return map_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
