"""Spelling variants, lexical packing and token alignment against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarryline.llm import align, packing, variants

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, n bigint, word string, start bigint, n_a bigint, key string, block int"
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (None, None), (6, "a\nb  c\t d \n\n e ▁x ﬁ① <s> </s> <|endoftext|> <0x41> "),
    (7, "Élan — naïve Σας İ ǅ ﬁ  x\x1cy\x00z q　r"), (8, "x" * 3000), (9, "w " * 5000), (10, "\nstart"), (11, " lead"), (12, "▁"), (13, "end\n"), (14, "a▁b c"), (15, "w" + " w" * 1022), (16, "😀 c‍😀\r\nq"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, 1, "w", 2, 3, "k", 4) for i, t in EDGE], SCHEMA)


def documents(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


# --- spelling variants ----------------------------------------------------------------------------

def brute_words(rows):
    n = Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}


def brute_variants(n):
    alphabet = sorted(set("".join(n)))
    near, form = {}, {}
    for w in n:
        around = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + d :] for d in (0, 1) for i in range(len(w) + 1 - d) for a in alphabet}
        near[w] = [x for x in around if x in n and x != w]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_variants_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, "sf0.01").select("doc_id", "text").collect()]
    want = brute_variants(brute_words(rows))
    assert any(f and r != f for _, f, r, *_ in want)  # forms of forms
    got = variants.spelling_variants(documents(spark, "sf0.01")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_variants_of_random_words(spark):
    """Few letters, so that runs of equal ones, ties and chains abound."""
    rng = random.Random(5)
    words = {"".join(rng.choices("aabé", k=rng.randint(6, 9))): rng.choice([5, 6, 25, 26, 125, 700, 4000]) for _ in range(1500)}
    words |= {"a" * 60: 5, "a" * 61: 5, "a" * 59 + "b": 30, "q" * 5000: 7, "q" * 2500 + "z" + "q" * 2500: 40}
    got = variants.variants(spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(5)).collect()
    assert len(got) == len(words)
    assert {tuple(r) for r in got if len(r.word) < 100} == brute_variants({w: n for w, n in words.items() if len(w) < 100})
    assert {(r.word[:1], r.n, r.n_near, r.form_n) for r in got if len(r.word) > 100} == {("q", 7, 1, 40), ("q", 40, 1, None)}


def test_variants_verify_strings(spark, monkeypatch):
    """With a key that nearly all words share, only the strings tell."""
    real = variants.deletion_keys
    monkeypatch.setattr(variants, "deletion_keys", lambda words: (real(words)[0] % 3, *real(words)[1:]))
    words = ["abcdefg", "abcdefh", "abcdef", "zbcdefg", "unlike"]
    held = [(i, w, 5) for i, w in enumerate(words)]
    rows = sorted((int(k), held[i][0], int(lo), int(hi), held[i][1], 5) for k, i, lo, hi in zip(*variants.deletion_keys(words), strict=True))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "id", "low", "high", "word", "n"])
    near = Counter()
    for b in variants._neighbours(iter([batch.slice(0, 9), batch.slice(9, 1), batch.slice(10)])):
        for r in b.to_pylist():
            near[words[r["id"]]] += r["near"]
    assert near == {"abcdefg": 3, "abcdefh": 2, "abcdef": 2, "zbcdefg": 1}


def test_variants_edges(spark, edge):
    rows = [(i, t) for i, t in EDGE] * 6
    doubled = edge.crossJoin(spark.range(6).withColumnRenamed("id", "clash"))
    assert {tuple(r) for r in variants.spelling_variants(doubled).collect()} == brute_variants(brute_words(rows))
    assert variants.spelling_variants(edge.where("false")).count() == 0
    assert variants.spelling_variants(edge.where("doc_id = 1")).count() == 0


# --- packing -----------------------------------------------------------------------------------

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def hold_packing(rows, got):
    """Each id in one piece, no gaps, no padding."""
    ids = defaultdict(list)
    for k, t in rows:
        ids[k].append(LIBRARY.encode(t or "", add_special_tokens=False).ids + [0])
    whole = Counter((k, x) for k, xs in ids.items() for ids_ in xs for x in range(len(ids_)))
    assert Counter((r.doc_id, x) for r in got for x in range(r.start, r.start + r.length)) == whole
    for r in got:
        assert r.length > 0 and any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    return sequences


def test_packing_keeps_every_id(spark):
    docs = documents(spark, "sf0.01")
    got = packing.pack_documents(docs, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    sequences = hold_packing([(r.doc_id, r.text) for r in docs.collect()], got)
    assert sum(sum(n for _, n in s) < 1024 for s in sequences.values()) <= 10


def test_packing_edges(spark, edge):
    hold_packing(EDGE, packing.pack_documents(edge).collect())
    assert packing.pack_documents(edge.where("false")).collect() == []
    assert [(r.doc_id, r.length) for r in packing.pack_documents(edge.where("doc_id = 1")).collect()] == [(1, 1)]


def test_packing_in_small_shards(spark, monkeypatch):
    """Shards that end within a batch, by documents and by terms."""
    for docs, terms in ((7, 10**9), (10**9, 500), (1, 1)):
        shards = []
        rows = [(i, " ".join(f"t{(i * 7 + j) % 50}" for j in range(i % 60))) for i in range(200)]
        monkeypatch.setattr(packing, "SHARD_DOCS", docs)
        monkeypatch.setattr(packing, "SHARD_TERMS", terms)
        got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        shards.append(got)
        hold_packing(rows, got)


def test_neighbours_are_the_best_by_plain_bm25():
    rng = random.Random(3)
    texts = [[rng.choice([rng.randint(0, 30), rng.randint(0, 400)]) for _ in range(rng.randint(1, 90))] for _ in range(400)]
    counted = [Counter(t) for t in texts]
    df = Counter(w for c in counted for w in c)
    n, mean = 1000, 40.0
    idf = np.array([math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in range(401)])
    length = np.array(list(map(len, texts)), float)
    shard = packing.Shard([np.array(sorted(c)) for c in counted], [np.array([c[w] for w in sorted(c)]) for c in counted], length, idf, mean)

    def score(seed, d):
        return sum(idf[w] * counted[d][w] * 2.2 / (counted[d][w] + 1.2 * (0.25 + 0.75 * length[d] / mean)) for w in counted[seed] if w in counted[d])

    for seed in (0, 17, 399):
        assert shard.scores(seed) == pytest.approx([score(seed, d) for d in range(400)])
    left = np.array(list(map(len, texts))) + 1
    used, rest = set(), None
    for pieces in packing.pack(shard, left, 256):
        if sum(p[2] for p in pieces) < 256:
            break  # the rest of the shard
        seed = pieces[0][0]
        assert rest is None or seed == rest
        used.add(seed)
        free = sorted((d for d in range(400) if d not in used), key=lambda d: (-round(shard.scores(seed)[d], 9), d))
        assert [p[0] for p in pieces[1:]] == free[: len(pieces) - 1]
        used |= {p[0] for p in pieces}
        last = pieces[-1]
        rest = last[0] if last[1] + last[2] < left[last[0]] else None


# --- alignment -----------------------------------------------------------------------------------

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PLAIN.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_alignment(rows):
    of, per, count = byte_of(), [], Counter()
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    for k, t in rows:
        s = " " + (t or "")
        a, b = PLAIN.encode(s, add_special_tokens=False).ids, PIECES.encode(t or "")
        bytes_a, bytes_b = [bytes(of[c] for c in PLAIN.id_to_token(i)) for i in a], [piece(PIECES.id_to_piece(i)) for i in b]
        if not t or b"".join(bytes_a) != s.encode() or b"".join(bytes_b) != s.encode():
            per.append((k, None))
            continue
        span = lambda parts: list(zip(np.cumsum([0, *map(len, parts)])[:-1].tolist(), np.cumsum(list(map(len, parts))).tolist(), strict=True))
        spans_a, spans_b = span(bytes_a), span(bytes_b)
        links, j = [], 0
        for i, (low, high) in enumerate(spans_a):
            while spans_b[j][1] <= low:
                j += 1
            x = j
            while x < len(b) and spans_b[x][0] < high:
                links.append((a[i], b[x]))
                x += 1
        groups, i, j = [], 0, 0
        for c in sorted({e for _, e in spans_a} & {e for _, e in spans_b}):
            own = [[], []]
            while i < len(a) and spans_a[i][1] <= c:
                own[0].append(str(a[i]))
                i += 1
            while j < len(b) and spans_b[j][1] <= c:
                own[1].append(str(b[j]))
                j += 1
            groups.append("|".join(map(",".join, own)))
        count.update(links)
        per.append((k, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(((k, *x[:3], len(x[3]), sum(count[p] == most[p[1]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) if x else (k, 0, 0, 0, 0, 0, 0, "") for k, x in per), key=repr)


def test_alignment_equals_brute_force(spark):
    docs = documents(spark)
    assert sorted(map(tuple, align.align_documents(docs).collect()), key=repr) == brute_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_edges(spark, edge):
    want = brute_alignment(EDGE)
    assert sum(w[1] == 0 for w in want) >= 4  # null, empty and not given back
    assert sorted(map(tuple, align.align_documents(edge).collect()), key=repr) == want
    assert align.align_documents(edge.where("false")).collect() == []


def test_alignment_in_windows_and_blocks(spark, monkeypatch):
    """Windows of a few characters, forgotten pieces and blocks of a few pairs change nothing."""
    rng = random.Random(1)
    texts = [t for _, t in EDGE] + ["".join(rng.choices([" ", "\n", "  ", "ab", "é", "▁", "the", "12", "😀", "\t"], [9, 2, 1, 5, 2, 0.1, 6, 3, 1, 0.2], k=300)) for _ in range(40)]
    want = brute_alignment(list(enumerate(texts)))
    book = align.pair(*align.default_vocabularies())
    monkeypatch.setattr(align, "WINDOW", 5)
    monkeypatch.setattr(align, "PIECES", 30)
    got = book.align_all(texts)
    assert [tuple(g[:4]) for g in got] == [(w[1], w[2], w[3], w[4]) for w in sorted(want)]
    assert [g[4] for g in got] == [w[7] for w in sorted(want)]
    monkeypatch.undo()
    monkeypatch.setattr(align, "BLOCK_PAIRS", 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(map(tuple, align.align_documents(df).collect()), key=repr) == want
