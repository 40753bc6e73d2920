"""The pipeline's stages, one by one on the rows of the stage before, against brute force."""

import hashlib

import pytest

import corpus_pipeline as P
from quarryline.llm import bpe, decontaminate, pii, toxicity
from quarryline.llm.common import cut

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in P.STAGES:
        made = cut(stage(spark, docs, DATA), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    scorer = toxicity.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    cache = toxicity.Recent(scorer.margin)
    assert after.columns == before.columns
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if scorer.score(r.text, cache) < 0.5)


def test_near_duplicates_stage(stages):
    before, after = stages["near_duplicates"]
    sets = {}
    for r in before.collect():
        w = (r.text or "").encode().lower().split()
        k = min(4, len(w))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    lead = {i: i for i in sets}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                lead[y] = x
    assert after.columns == before.columns and sorted(r.doc_id for r in after.collect()) == sorted(i for i in ids if root(i) == i)


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(13, len(w))]) for w in items for i in range(len(w) - min(13, len(w)) + 1) if w}
    kept = []
    for r in before.collect():
        w, hit = decontaminate.words(r.text), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
        if not hit or 20 * len(hit) < len(w):
            kept.append(r.doc_id)
    assert after.columns == before.columns and sorted(r.doc_id for r in after.collect()) == sorted(kept)


def test_pii_stage(stages):
    before, after = stages["pii"]
    finder = pii.Finder(pii.train(before))
    want = {r.doc_id: pii.redact(r.text, finder) for r in before.collect()}
    got = {r.doc_id: r for r in after.collect()}
    assert after.columns == before.columns and {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)
    assert not any(pii.base_spans(t) for t in want.values() if t)


def test_bpe_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages["bpe"]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.no_truncation()
    whole.no_padding()
    got = {r.doc_id: bytes(r.ids) for r in after.collect()}
    for r in before.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        assert hashlib.sha256(got[r.doc_id]).digest() == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).digest()
    assert len(got) == before.count() and bpe.decode_ids(b"") == ""


def test_stages_with_odd_rows(spark):
    """Null and empty texts, null ids, repeated rows, clashing further columns, empty tables."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, lead bigint, _id bigint, score double"
    rows = [(1, None, "en", "s", 0, 1, 1, 0.1), (2, "", "en", "s", 0, 1, 1, 0.1), (3, "a b c", None, None, None, 1, 1, None), (3, "a b c", None, None, None, 1, 1, None), (None, "a b c d", "en", "s", 7, 1, 1, 0.2), (4, "w " * 30_000, "en", "s", 1, 1, 1, 0.3)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in P.STAGES:
            made = stage(spark, docs, DATA)
            if name == "near_duplicates":
                ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in made.collect())
                # the row without an id links with nothing and names no component with an id: it stays
                assert ids == ([-1, 1, 2, 3, 4] if docs.take(1) else [])
            elif name != "bpe":
                assert made.columns == docs.columns and made.count() == docs.count()
            else:
                assert made.count() == docs.count()


def test_near_duplicates_are_told_apart_by_row(spark):
    """Copies under null ids, under repeated ids, and repeated rows."""
    word = [f"w{i}" for i in range(300)]
    near = " ".join(["v", *word[1:]])
    text = " ".join(word)
    rows = [(1, text, "a"), (None, near, "a"), (None, "an unrelated text without an id", "a"), (1, text, "b"), (1, text, "a"), (7, "other words of seven here", "a"), (7, text, "c"), (None, "twice the same", "a"), (None, "twice the same", "b"), (8, "", "a"), (8, "", "a"), (8, "", "b"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string")
    got = P.unique(spark, docs, DATA).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got if r.text) == sorted([(1, text), (0, "an unrelated text without an id"), (7, "other words of seven here"), (0, "twice the same")])
    assert sorted((r.doc_id or 0, r.text, r.id) for r in got if not r.text) == [(0, None, "a"), (8, "", "a"), (8, "", "b")]


def test_decontamination_with_clashing_names(spark):
    bench = spark.createDataFrame([(f"i{i}", " ".join(f"b{i}x{j}" for j in range(13))) for i in range(3)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "b1x" + " b1x".join(map(str, range(13))), 5, "q"), (2, "plain words", 5, "q"), (None, None, 5, "q")], "doc_id bigint, text string, _id int, _digest string")
    for block_bytes in (1, decontaminate.BLOCK_BYTES):
        kept = decontaminate.clean_documents(docs, bench, block_bytes=block_bytes)
        assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2]
        got = decontaminate.contaminated(docs, bench, block_bytes=block_bytes).collect()
        assert sorted((r.doc_id or 0, r.contaminated) for r in got) == [(0, False), (1, True), (2, False)]
