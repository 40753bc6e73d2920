"""The corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from array import array

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm import audio, bpe, decontaminate, html, jaccard, language, pii, rollup, token_file, toxicity

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, cls string"
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, "one two three four five six"), (6, "one two three four five six"), (7, "Élan — naïve Σας İ ǅ ﬁ  x\x1cy"), (8, "x" * 5000), (9, "it's 12,345.67!! <|endoftext|> a  b\n\n c‍😀"), (None, "one two"), (10, "mail a.b@c.org or +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.256 10.0.0.25")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "c") for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(4, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 100 * len(sets[i]) < 85 * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_equals_brute_force(spark):
    some = docs(spark).where("n_chars < 4000")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(some).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in some.collect()])


def test_jaccard_edges(edge, empty):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(edge).collect())
    assert len(got) == len(EDGE)
    assert (-1, 1, 4) in got and (5, 1, 4) in got and got.count((6, 3, 6)) == 2 and (1, 0, 1) in got
    assert jaccard.jaccard_join(empty).count() == 0


def test_jaccard_null_ids_and_chains(spark):
    """Near copies of which one has no id, a class without any id, and a chain of links."""
    word = [f"w{i}" for i in range(400)]
    text = lambda *swap: " ".join(f"v{i}" if i in swap else w for i, w in enumerate(word))
    rows = [(9, text()), (7, text(3)), (None, text(5)), (None, text(5)), (4, "other words that link with nothing here"), (None, "alone without an id and a link"), (8, None)]
    # each step of the chain changes more: the ends do not link with each other
    rows += [(100 + i, " ".join(["chain"] + [f"c{j}" for j in range(i * 4, i * 4 + 120)])) for i in range(6)]
    got = [(r.doc_id, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert got.count((None, 7)) == 2 and (9, 7) in got and (4, 4) in got and (None, None) in got and (8, 8) in got
    assert {c for i, c in got if i and i >= 100} == {100}


def test_bpe_many_special_tokens():
    book, whole = bpe.codec(bpe.default_vocabulary()), library("word_bpe_49k.json")
    for text in ("<|endoftext|>" * 3000, "a <|endoftext|> b<|endoftext|>", "<|endoftext|>", " <|endoftext|>  x"):
        want = whole.encode(text, add_special_tokens=False).ids
        ids, decoded = book.encode(text)
        assert list(array("I", ids)) == want and decoded == whole.decode(want, skip_special_tokens=False)


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(spark, edge, empty):
    t = library("word_bpe_49k.json")
    for frame in (docs(spark), edge):
        text = {(r.doc_id, r.text) for r in frame.collect()}
        got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame).collect()}
        want = set()
        for i, x in text:
            ids = t.encode(x or "", add_special_tokens=False).ids
            want.add((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == want
    assert bpe.digests(empty).count() == 0


def test_token_file_equals_library(spark, edge, empty):
    t = library("byte_bpe_50k.json")
    for frame in (docs(spark), edge.where("doc_id is not null")):
        at, want = 0, []
        for r in sorted(frame.collect(), key=lambda r: r.doc_id):
            ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
            want.append((r.doc_id, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
            at += len(ids)
        assert sorted(map(tuple, token_file.digests(frame).collect())) == want
    assert token_file.digests(empty).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_token_index_over_shards(spark, tmp_path, kind):
    t = library("byte_bpe_50k.json")
    rows = [(i * 7, f"text {i} of words") for i in range(300)] + [(None, "no key")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = token_file.write_ids(df, f"file://{tmp_path}/{kind}")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = token_file.Index(manifest, most=2)
    make = {"bigint": int, "string": str, "double": float}[kind]
    assert manifest.count() > 2
    for i in (0, 1, 150, 299):
        assert index.get(make(i * 7)).tolist() == [*t.encode(f"text {i} of words", add_special_tokens=False).ids, 2]
        assert index.get(make(i * 7 + 3)) is None
    assert index.get(make(-5)) is None and index.get(None).tolist() == [*t.encode("no key", add_special_tokens=False).ids, 2]


def test_token_pieces_forget_and_relearn(monkeypatch):
    t = library("byte_bpe_50k.json")
    monkeypatch.setattr(token_file, "PIECES", 40)
    book = token_file.Encoder(token_file.default_vocabulary())
    texts = [" ".join(f"w{i * j}x{j}" for j in range(30)) + "\nline é" for i in range(20)] + [None, "", "a  b\t"]
    for _ in range(2):
        assert [list(array("H", x)) for x in book.encode_all(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_decontamination_equals_brute_force(spark, edge):
    bench = spark.createDataFrame([(1, "two three four"), (2, None), (3, " ".join(f"w{i}" for i in range(20))), (4, "")], "item_id bigint, text string")
    more = edge.union(spark.createDataFrame([(20, "x " + " ".join(f"W{i}," for i in range(3, 18)) + " y", "en", "s", 1, 0.0, "")], edge.schema))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contaminated(more, bench).collect()}
    assert got[6] == (6, 3, 1, True) and got[20] == (17, 15, 1, True) and got[1] == (0, 0, 0, False)
    small = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contaminated(more, bench, block_bytes=1).collect()}
    assert small == got
    kept = {r.doc_id for r in decontaminate.clean_documents(more, bench).collect()}
    assert kept == {i for i, r in got.items() if not r[3]}


def test_clean_documents_adds_up_blocks(spark):
    bench = spark.createDataFrame([(1, "aa ab ac"), (2, "ba bb bc")], "item_id bigint, text string")
    rest = " ".join(f"z{i}" for i in range(94))
    rows = [(1, f"aa ab ac {rest} ba bb bc"), (2, f"aa ab ac {rest}"), (None, f"aa ab ac {rest} ba bb bc"), (1, rest), (1, rest), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "c") for i, t in rows], SCHEMA)
    for block_bytes in (1, decontaminate.BLOCK_BYTES):
        kept = decontaminate.clean_documents(docs, bench, block_bytes=block_bytes)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], *rows[3:]], key=str)


def test_decontamination_does_not_depend_on_blocks(spark):
    bench = spark.createDataFrame([(None, "na nb nc"), (1, "aa ab ac"), (2, "ba bb bc"), (2, "ba bb bc")], "item_id bigint, text string")
    rows = [(1, "aa ab ac x"), (1, "y ba bb bc"), (1, "y ba bb bc"), (1, "one"), (None, "na nb nc aa ab ac"), (None, "u v"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "c") for i, t in rows], SCHEMA)
    want = [(1, 4, 3, ["1"]), (1, 4, 3, ["2"]), (1, 4, 3, ["2"]), (1, 1, 0, []), (None, 6, 6, ["1"]), (None, 2, 0, []), (2, 0, 0, [])]
    for block_bytes in (1, decontaminate.BLOCK_BYTES):
        got = decontaminate.occurrences(docs, bench, block_bytes=block_bytes).collect()
        assert sorted(((r.doc_id, r.n_words, len(r.hits), r["items"]) for r in got), key=str) == sorted(want, key=str)
    assert max(len(b) for b in decontaminate.blocks(bench, 1)) == 1 and len(list(decontaminate.blocks(bench, 1))) == 3


def test_language_held_out(spark, edge, empty):
    r = language.identify(docs(spark)).join(docs(spark).select("doc_id", "lang"), "doc_id").where("held_out")
    assert r.where("lang = lang_pred").count() >= 0.97 * r.count()
    got = {x.doc_id: x.lang_pred for x in language.identify(edge).collect()}
    assert got[1] == got[2] == "und" and language.identify(empty).count() == 0


def brute_language(rows):
    """Predictions of (doc_id, text, lang) rows by plain counting."""
    import math
    import re
    from collections import Counter, defaultdict

    words_in = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    seen = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            seen[lang].update(words_in(t))
    cost, worst = defaultdict(dict), Counter()
    for lang, words in seen.items():
        tables = {0: words} | {n: Counter() for n in range(1, 7)}
        for w, c in words.items():
            for n in range(1, 7):
                for a in range(len(w) + 3 - n):
                    tables[n][f" {w} "[a : a + n]] += c
        for n, table in tables.items():
            total = sum(table.values())
            for gram, c in sorted(table.items(), key=lambda x: (-x[1], x[0]))[: 5_000 if n else 10_000]:
                cost[n, gram][lang] = round(-math.log10(c / total) * 10_000)
                worst[n] = max(worst[n], cost[n, gram][lang])
    langs = sorted(seen)

    def of(n, gram):
        return [cost[n, gram].get(g, worst[n] + 10_000) for g in langs]

    def word(w):
        if (0, w) in cost:
            return of(0, w)
        w = f" {w} "
        for n in range(min(6, len(w)), 0, -1):
            found = [of(n, w[a : a + n]) for a in range(len(w) - n + 1) if (n, w[a : a + n]) in cost]
            if found:
                return [sum(c) // len(found) for c in zip(*found, strict=True)]
        return [max(worst.values()) + 10_000] * len(langs)

    out = {}
    for i, t, _ in rows:
        words = words_in(t)
        if not words:
            out[i] = ("und", 0.0)
            continue
        total = [sum(c) / (len(words) * 10_000) for c in zip(*map(word, words), strict=True)]
        p = [math.exp(-3 * (c - min(total))) for c in total]
        best = total.index(min(total))
        out[i] = (langs[best], p[best] / sum(p))
    return out


def test_language_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + i, t, None) for i, t in enumerate(["", "12 34", None, "zzqx qqq", "a", "ß", "x" * 3000])]
    df = spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in rows], "doc_id bigint, text string, lang string, score string, n int")
    got, want = language.identify(df).collect(), brute_language(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred, r.held_out) == (want[r.doc_id][0], zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.score == pytest.approx(want[r.doc_id][1])


def test_language_ties_go_to_the_first_name(spark):
    same = spark.createDataFrame([(i, "one two three", g) for i, g in ((1, "b"), (3, "a"), (4, "c"), (5, "b"), (7, "a"), (8, "c"))], "doc_id bigint, text string, lang string")
    learnt = {r.lang for r in same.where(~language.held_out()).collect()}
    assert len(learnt) > 1 and {r.lang_pred for r in language.identify(same).collect()} == {min(learnt)}


def test_toxicity_held_out(spark, edge, empty):
    big = "/root/testdata/sf0.1"
    d, l = spark.read.parquet(f"{big}/documents.parquet").where("n_chars < 3000"), spark.read.parquet(f"{big}/labels.parquet")
    scorer = toxicity.train(d, l)
    r = toxicity.score(d, scorer).join(l, "doc_id").where(toxicity.held_out("doc_id", 5, 0))
    assert r.where("toxic = 1 and score >= 0.5").count() >= 0.85 * r.where("toxic = 1").count()
    assert r.where("toxic = 0 and score < 0.5").count() >= 0.9 * r.where("toxic = 0").count()
    assert scorer.margin("i.d.i.o.t") > 0 and "idiot" in scorer.suspects("you i d i o t")
    assert toxicity.judge(edge, l).count() == len(EDGE) and toxicity.judge(empty, l).count() == 0


def test_toxicity_units_that_account_for_labels():
    """All frequent insults are kept, however many; what only comes beside one (copies of a text) is not."""
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(9))
    insults, plain = [word("bdgkmpuz") for _ in range(100)], [word("aeilnorst") for _ in range(300)]
    bags = [frozenset({u}) for u in insults for _ in range(10)] + [frozenset({insults[0], "bystander"})] * 5 + [frozenset({"chance"})]
    counts = [(u, 10 + 5 * (u == insults[0]), 0) for u in insults] + [(u, 20, 200) for u in plain] + [("bystander", 5, 0), ("chance", 1, 0)]
    counts[0] = (insults[0], 15, 0)
    scorer = toxicity.Scorer(sorted(counts), bags)
    assert set(scorer.typical) == set(insults)
    cache = toxicity.Recent(scorer.margin)
    assert all(scorer.score(f"so {u} it is", cache) >= 0.5 for u in insults) and all(scorer.score(f"so {u} it is", cache) < 0.5 for u in plain)
    gapped = insults[5]
    assert scorer.score(f"so {' '.join(gapped)} it is", cache) >= 0.5 and scorer.score(f"so {'.'.join(gapped)} it is", cache) >= 0.5 and scorer.score(f"so {gapped[:4]}*{gapped[4:]}!! it is", cache) >= 0.5


def test_rollup_is_idempotent(spark, edge, tmp_path):
    ledger = rollup.Rollup(spark, f"file://{tmp_path}")
    words = rollup.count_words(edge)
    assert ledger.commit("a", rollup.signed(words, 1)) and not ledger.commit("a", rollup.signed(words, 1))
    once = sorted(map(tuple, ledger.totals().collect()))
    ledger.compact("1")
    assert sorted(map(tuple, ledger.totals().collect())) == once and not ledger.commit("a", rollup.signed(words, 1))
    assert ledger.commit("b", rollup.signed(words, -1)) and ledger.totals().count() == 0


def test_rollup_compacts_again_and_again(spark, edge, empty, tmp_path):
    ledger = rollup.Rollup(spark, f"file://{tmp_path}")
    words = rollup.count_words(edge)
    n = lambda: sum(r.n_docs for r in ledger.totals().collect())
    ledger.commit("a", rollup.signed(words, 1))
    assert ledger.compact("1") and ledger.commit("b", rollup.signed(words, 1))
    assert not ledger.compact("1") and n() == 2 * len(EDGE)  # a name that was used folds nothing and loses nothing
    assert ledger.compact("2") and not ledger.commit("a", rollup.signed(words, 1)) and n() == 2 * len(EDGE)
    assert ledger.commit("none", rollup.signed(rollup.count_words(empty), 1)) and n() == 2 * len(EDGE)
    assert rollup.token_counts(empty, "s", f"file://{tmp_path}/e").count() == 0


def test_rollup_folds_do_not_overlap(spark, edge, tmp_path):
    """Of two folds at once one is refused; a fold that died goes on under its name; what no longer counts can go."""
    ledger = rollup.Rollup(spark, f"file://{tmp_path}")
    words = rollup.count_words(edge.where("doc_id = 4"))
    tokens = lambda: [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()]
    ledger.commit("a", rollup.signed(words, 1))
    real, calls = ledger._write, []

    def interrupted(name, sums, members):
        if not calls:
            calls.append(name)
            with pytest.raises(RuntimeError, match="another fold"):
                ledger.compact("other")
            raise OSError("lost")
        return real(name, sums, members)

    ledger._write = interrupted
    with pytest.raises(OSError):
        ledger.compact("one")
    with pytest.raises(RuntimeError):
        ledger.compact("other")
    assert tokens() == [(1, 2)]
    ledger.commit("b", rollup.signed(words, 1))
    assert ledger.compact("one") and tokens() == [(2, 4)] and ledger.compact("other") and tokens() == [(2, 4)]
    assert ledger.vacuum() == 3 and ledger.vacuum() == 0 and tokens() == [(2, 4)]
    assert not ledger.commit("a", rollup.signed(words, 1)) and not ledger.compact("one") and tokens() == [(2, 4)]


def test_rollup_batch_written_twice_at_once(spark, edge, tmp_path):
    ledger = rollup.Rollup(spark, f"file://{tmp_path}")
    ledger.known = lambda batch: False  # as two writers see it that begin together
    words = rollup.signed(rollup.count_words(edge), 1)
    assert ledger.commit("a", words) and not ledger.commit("a", words)
    assert sum(r.n_docs for r in ledger.totals().collect()) == len(EDGE)


def test_rollup_counts_ids(edge):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in EDGE)
    got = rollup.count_ids(edge, "word-1").collect()
    assert len(got) == len(EDGE) and sum(r.n for r in got) == want and {(r.source, r.lang, r.tokenizer) for r in got} == {("s", "en", "word-1")}


def test_audio_payload_that_looks_like_tags(spark, empty):
    """Old and new tags, syncs and tables at every place of the payload's end."""
    for mark in (b"TAG", b"ID3", b"\xff\xfb\x90\x44", b"Xing", b"VBRI"):
        for n in range(0, 420, 1 if mark == b"TAG" else 7):
            payload = (b"x" * n + mark * 50).ljust(-(-(n + 50 * len(mark)) // 64) * 64, b"\0")
            assert audio.read_back(audio.store(payload)) == payload
    media = audio.store(b"p" * 6400)
    info = audio.parse(media + b"TAG".ljust(128, b"t"))
    assert info["offsets"] == audio.parse(media)["offsets"] and not info["skipped"] and audio.read_back(media, info) == b"p" * 6400
    texts = spark.createDataFrame([(i, "x" * (i % 3) + "TAG" * i) for i in range(0, 200, 5)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_bytes for r in audio.digests(texts).collect()} == {r.doc_id: len(r.text) for r in texts.collect()}
    assert audio.digests(empty).count() == 0


def test_audio_reads_the_other_table():
    import struct

    head = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 9999, 40, 3, 2, 2, 10) + struct.pack(">HHH", 100, 110, 120)
    frame = bytearray(audio._frame(8, b""))
    frame[36 : 36 + len(head)] = head
    info = audio.parse(bytes(frame) + audio._frame(8, b"a") * 3)
    assert info["vbr"] == {"bytes": 9999, "frames": 40, "seek": [0, 200, 420, 660], "frames_a_step": 10} and len(info["offsets"]) == 3
    assert audio.vbri(b"VBRI") == {}


def test_audio_round_trip(edge):
    for r in audio.store_documents(edge).collect():
        info = audio.parse(r.media)
        assert not info["bad"] and not info["skipped"] and info["vbr"]["frames"] == len(info["offsets"])
        assert len(audio.read_back(r.media)) % 64 == 0
    media = audio.store(bytes(range(256)) * 40)
    damaged = media[:300] + b"\xff\xfbjunk" + media[300:]
    assert audio.parse(damaged)["skipped"] > 0
    assert audio.digests(edge).count() == len(EDGE)


def test_pii_base_spans(edge, empty):
    text = EDGE[-1][1]
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b@c.org"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert pii.personal_data(edge).count() == len(EDGE) and pii.personal_data(empty).count() == 0


def test_pii_adds_masked_address():
    w = pii.fit([f"mail u{i}.x@host{i}.example.org" for i in range(40)] + [f"version {i}.2" for i in range(40)])
    text = "to joe7.x[at]host9.example.org now"
    base, every = pii.Finder(w).find(text)
    assert not base and [text[a:b] for _, a, b in every] == ["joe7.x[at]host9.example.org"]


def test_pii_adds_masked_address_without_digits():
    w = pii.fit([f"mail u{i}.x@host{i}.example.org" for i in range(40)] + [f"version {i}.2" for i in range(40)])
    finder = pii.Finder(w)
    for own in ("jane.doe[at]example.org", "jane (at) example.org", "jane.doe [at] example.org", "jane(at)example.org"):
        for text in (own, f"write to {own} now", f"or\n{own}, please"):
            assert [(k, text[a:b]) for k, a, b in finder.find(text)[1]] == [("email", own)], text
        assert pii.redact(f"write to {own} now", finder) == "write to <email> now"
    for text in ("we meet (at) noon", "look [at] this", "at home", "(at)"):
        assert finder.find(text) == ([], [])


def div_page(i):
    body = "".join(f"<p>{' '.join(f'word{i}x{j}' for j in range(40))}</p>" for _ in range(3))
    return f'<html><body><div class="menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div><div class="content"><h1>Title {i}</h1>{body}</div><div class="footer">Copyright <a href="/">us</a></div></body></html>'


def test_html_without_marked_pages(spark):
    schema = "page_id bigint, url string, html string"
    divs = [(i, "u", div_page(i)) for i in range(30)]
    want = {i: "\n".join([f"Title {i}"] + [" ".join(f"word{i}x{j}" for j in range(40))] * 3) for i in range(30)}
    marked = [(100 + i, "u", div_page(i).replace('<div class="content">', "<article>").replace("</div><div class=\"footer", "</article><div class=\"footer")) for i in range(30)]
    for rows in (divs, divs + marked):
        got = html.extract_pages(spark.createDataFrame(rows, schema)).collect()
        assert len(got) == len(rows) and all(r.text == want[r.page_id % 100] for r in got)


def test_html(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    trees = html.train(pages)
    page = "<body><nav><a href=/>Home</a></nav><div class=content><h1>T &amp; U</h1><p>" + "word " * 60 + "<p>two<br>three</div><div id=comments><p>me too</p></div><script>x='<p>'</script>"
    assert html.extract(trees, page) == "T & U\n" + ("word " * 60).strip() + "\ntwo three"
    assert html.extract(trees, None) == html.extract(trees, "") == ""
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>")], "page_id bigint, url string, html string")
    assert html.main_text(odd, trees).where(F.col("n_chars") == 0).count() >= 2


def test_audio_digests_equal_brute_force(spark, edge, empty):
    for frame in (docs(spark).limit(200), edge):
        texts = {}
        for r in frame.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, set()).add(r.text)
        got = audio.digests(frame).collect()
        for r in got:
            if len(texts[r.doc_id]) > 1:
                continue
            data = (next(iter(texts[r.doc_id])) or "").encode()
            padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert len(got) == frame.count()
    assert audio.digests(empty).count() == 0


def brute_base_spans(text):
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_pii_base_spans_equal_brute_force(spark, edge):
    rng = random.Random(3)
    made = ["".join(rng.choice(["1", "4", "55", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "4111 1111 1111 1111", "10.0.0.7", "x@y.zz"]) for _ in range(rng.randint(1, 25))) for _ in range(5000)]
    for t in made + [r.text or "" for r in docs(spark).limit(300).collect()] + [t or "" for _, t in EDGE]:
        assert pii.base_spans(t) == brute_base_spans(t)


def test_html_wide_and_broken_pages(spark):
    import time

    trees = html.fit([])
    wide = "<html><body><article>" + "".join(f"<p>line {i} of the article</p>" for i in range(20_000)) + "</article></body></html>"
    began = time.time()
    assert html.extract(trees, wide).count("\n") == 19_999
    broken = "<body><div>" + '<a href="x>text ' * 2000 + "<!" * 2000
    html.extract(trees, broken)
    assert time.time() - began < 60
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html.extract_pages(empty).count() == 0
    twice = spark.createDataFrame([(1, "u", wide[:3000]), (1, "u", wide[:3000]), (2, None, None)], "page_id bigint, url string, html string")
    rows = sorted((r.page_id, r.text) for r in html.extract_pages(twice).collect())
    assert rows[0] == rows[1] and rows[0][1].startswith("line 0 of the article") and rows[2] == (2, "")


def planted(rng):
    """An entity as the patterns miss it, or a near miss, in a sentence: text and spans."""
    d = lambda k: "".join(rng.choices("0123456789", k=k))

    def card(good):
        head = "4" + d(14)
        last = next(c for c in "0123456789" if pii.luhn(head + c))
        n = head + (last if good else str((int(last) + 1) % 10))
        return ".".join(n[i : i + 4] for i in range(0, 16, 4))

    def email():
        name, host = rng.choice(["jane.doe", "bob", "k_m", "x.y-z"]), rng.choice(["example.org", "mail.test.net", "corp.io"])
        mask = rng.choice(["[at]", "(at)", " [at] ", " (at) ", " at "])
        return f"{name} at {host.replace('.', ' dot ')}" if mask == " at " else name + mask + host

    frame = rng.choice(["Please write to {} soon.", "Our record shows {}, as agreed", "contact: {}", "see {} for more", "{}"])
    if rng.random() < 0.5:
        kind = rng.choice(["email", "card", "phone", "ip"])
        own = email() if kind == "email" else card(True) if kind == "card" else "[.]".join(str(rng.randint(0, 255)) for _ in range(4)) if kind == "ip" else rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"1 {d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])
        text = frame.format(own)
        return text, {(kind, text.index(own), text.index(own) + len(own))}
    own = rng.choice([f"{d(3)}-{d(2)}-{d(4)}", f"192.168.{rng.randint(0, 255)}.{rng.randint(256, 999)}", card(False), f"20{d(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{d(6)}.{d(2)}", d(rng.randint(8, 15)), f"19{d(2)}-20{d(2)}", f"978-3-16-{d(6)}-{d(1)}", f"{d(2)}-{d(6)}", f"1 {d(3)} {d(3)} {d(3)}", f"{d(4)}-{d(2)}-{d(5)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(2)}/{d(2)}/{d(4)}"])
    return frame.format(own), set()


@pytest.fixture(scope="module")
def finder(spark):
    return pii.Finder(pii.train(docs(spark)))


def test_pii_on_planted_entities_and_near_misses(finder):
    rng = random.Random(99)
    right = wrong = missed = 0
    for _ in range(800):
        text, want = planted(rng)
        got = set(finder.find(text)[1])
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9


@pytest.mark.parametrize(("text", "want"), [("ssn 123-45-6789", []), ("192.168.1.300", []), ("4111.1111.1111.1111", [("card", 0, 19)]), ("john at example dot com", [("email", 0, 23)]), ("4111 1111 1111 1111 4012 8888 8888 1881", [("card", 0, 19), ("card", 20, 39)])])
def test_pii_bounds(finder, text, want):
    assert finder.find(text)[1] == want


def test_words_learnt_one_by_one_are_the_librarys(spark):
    """Every code point below the border, contractions, numbers and marks between letters."""
    rng = random.Random(8)
    book = token_file.Encoder(token_file.default_vocabulary())
    signs = [chr(c) for c in range(33, ord(token_file.SETTLED) + 40) if not chr(c).isspace()] + ["'s", "'ll", "'S", "12", "ab", "日本", "😀", "\u0301"]
    texts = [" ".join("".join(rng.choices(signs, k=rng.randint(1, 6))) for _ in range(40)) for _ in range(300)]
    for t, packed in zip(texts, book.encode_all(texts), strict=True):
        assert packed == book.whole(t)


def neutral_page(rng):
    """A family of pages that isn't learnt from: divs with meaningless classes, a menu, a notice, a sidebar and comments. The
    page and its article's words."""
    say = lambda k: " ".join("".join(rng.choice("aeinorstlu") for _ in range(rng.randint(2, 9))) for _ in range(k))
    c = lambda: f'class="x{rng.randint(1, 99)}"'
    links = lambda k, low=1, high=3: "".join(f'<div {c()}><a href="/a">{say(rng.randint(low, high))}</a></div>' for _ in range(k))
    block = [lambda: f"<p>{say(rng.randint(30, 120))}</p>", lambda: f"<p>{say(rng.randint(30, 80))} <a href='/'>{say(2)}</a> {say(10)}</p>", lambda: f"<h2>{say(4)}</h2>", lambda: "<ul>" + "".join(f"<li>{say(rng.randint(5, 15))}</li>" for _ in range(3)) + "</ul>"]
    own = f"<h1>{say(6)}</h1>" + "".join(rng.choice(block)() for _ in range(rng.randint(3, 9))) + f"<p>{say(40)}</p>"
    side = f"<div {c()}><div {c()}>{say(2)}</div>{links(rng.randint(3, 6), 2, 6)}</div>" if rng.random() < 0.6 else ""
    notice = f"<div {c()}><p>{say(rng.randint(8, 20))}</p><button>{say(1)}</button></div>" if rng.random() < 0.5 else ""
    said = "".join(f"<div {c()}><div {c()}>{say(2)}</div><p>{say(rng.randint(5, 40))}</p></div>" for _ in range(rng.randint(2, 5)))
    comments = f"<div {c()}><h3>{say(2)}</h3>{said}</div>" if rng.random() < 0.6 else ""
    foot = f"<div {c()}>{say(6)} <a href='/'>{say(2)}</a></div>"
    return f"<html><body><div {c()}>{links(rng.randint(4, 9))}</div>{notice}<div {c()}><div {c()}>{own}</div>{side}</div>{comments}{foot}</body></html>", words_of(own)


def words_of(markup):
    import html as references
    import re

    return references.unescape(re.sub("<[^>]*>", " ", markup)).split()


def agreement(pairs):
    from collections import Counter

    both = sum(sum((Counter(a) & Counter(b)).values()) for a, b in pairs)
    return both / sum(len(b) for _, b in pairs), both / sum(len(a) for a, _ in pairs)


def test_html_on_pages_without_telling_names(spark):
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    trees = html.train(pages)
    rng = random.Random(5)
    made = [neutral_page(rng) for _ in range(60)]
    assert min(agreement([(want, html.extract(trees, page).split()) for page, want in made])) >= 0.9
    # the given pages: the article without asides and forms, with and without names
    cut = lambda p: words_of(re.sub(r"<(aside|form|script|style)\b.*?</\1>", "", p[re.search("<article[^>]*>", p).end() : p.rfind("</article>")], flags=re.S))
    given = [r.html for r in pages.collect() if "</article>" in r.html]
    assert len(given) > 200 and min(agreement([(cut(p), html.extract(trees, p).split()) for p in given])) >= 0.99
    plain = lambda p: re.sub(r'\s(?:class|id|role)="[^"]*"', "", re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b", r"<\1div", p))
    assert min(agreement([(cut(p), html.extract(trees, plain(p)).split()) for p in given])) >= 0.9
