"""N-gram Jaccard join with set-relation skipping.

Documents become sets of word shingles; equal sets are one class. The join of the classes goes from
the shingles that documents share, so that texts are never moved and most sets are left out early.

*Shared shingles.* Every shingle is dealt to a bucket by its hash, and a bucket tells which of its
shingles occur in more than one place. A set of which less than the threshold's share is shared can
link with nothing and goes; the others are put together from their shared shingles, which are all that
an overlap can consist of.

*Index skipping.* A set is listed under the first of its ``n - ceil(t n) + 1`` shingles, rarest first (those
that nothing shares come first and need no list). The rows of a list form blocks of equal
component, size and position. A pair of blocks is skipped whole where both are of one component,
or where the best overlap that size and position leave is below what the threshold asks.

*Answer skipping.* First each set is compared only with the hub of each of its lists, the set with the
smallest share of shingles of its own. The overlaps with hubs are the computed answers; their links give
components, and within a component nothing is searched again. A pair that the index still finds between components
has its answer derived from the two overlaps with a common hub where these bound it on either side of the
threshold; the rest are compared in full. So the components are exact, but links within one
are not all listed.

Nothing grows in the driver or is broadcast by hand; no list, hub or bucket is capped. Shingles are told apart by
40 bits of hash and the bucket they fall in.

Null or word-less texts have the empty set and no links. Repeated rows are copies. A row whose
``doc_id`` is null takes the smallest ``doc_id`` of its component, null if there is none. Further columns are
ignored, whatever their names; an empty table gives an empty result. ``docs`` must give the same rows in the same order
when a task is repeated, as a file scan does; where it doesn't, the job fails instead of losing links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut

WORDS = 4
PERCENT = 85
#: Shingles in a bucket (which a task holds at a time), and the least number of buckets.
BUCKET, BUCKETS = 2_000_000, 64
#: Shingles that a task gathers before it deals them out.
CHUNK = 1_000_000
#: Partners that are compared with one copy of a hub's set.
FAN = 256
#: Sets that a task remembers so as not to deal out their copies.
SEEN = 200_000
LOW = 40  # bits of a shingle's hash that are kept beside its bucket
KEY = 12  # bytes of a class key: no collision to expect among 10^11 sets

#: Bytes of a text that are hashed at a time.
PIECE = 1 << 15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_power = _inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a fixed odd number and of its inverse; the tables grow with the longest piece."""
    global _power, _inverse
    if n > len(_power):
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _power, _inverse = tables
    return _power[:n], _inverse[:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text: a polynomial over its bytes, taken for all words at once
    from running sums. Long texts are taken in pieces that end at a blank."""
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        at = end
        inside = np.zeros(len(raw) + 2, bool)
        np.logical_not(_BLANK[raw], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        if not edges.size:
            continue
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power, out=sums[1:])
        out.append(_mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes. Lower case for A-Z only; words
    are parted by blanks and the controls 9 to 13."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not h.size:
        return np.zeros(0, np.uint64)
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out = _mix(out)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=KEY).digest()


def features(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, cls`` of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, k) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([s.size for s in sets], pa.int64()), pa.array([set_key(s) if s.size else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "cls"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, cls binary")


def _packed(who: np.ndarray) -> bytes:
    """Ascending numbers as compressed steps."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(who, prepend=0).astype("<u4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4"), dtype=np.int64)


def _narrow(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW // 8].tobytes()


def _wide(data: bytes, bucket: int) -> np.ndarray:
    out = np.zeros((len(data) * 8 // LOW, 8), np.uint8)
    out[:, : LOW // 8] = np.frombuffer(data, np.uint8).reshape(-1, LOW // 8)
    return out.view("<u8").ravel() | np.uint64(bucket << LOW)


DEALT = "bucket int, head boolean, chunk bigint, who binary, low binary, seen binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bucket", "head", "chunk", "who", "low", "seen"])


def dealt(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """The shingles of all sets by bucket. A task gathers sets in chunks and writes one row for each bucket
    of a chunk: ``who`` (places of the sets in the chunk) and ``low``. The ``head`` row of a chunk has the sets' sizes
    and classes. A chunk is named by its classes."""
    bound_batches(docs.sparkSession)

    def flush(keys: list[bytes], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        name = b"".join(keys)
        chunk = int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little", signed=True)
        sizes = np.array([s.size for s in sets], "<u4")
        tokens, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        bucket = ((tokens >> np.uint64(LOW)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        tokens, who, bucket = tokens[order], who[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets + 1))
        rows = [(chunk % buckets, True, chunk, sizes.tobytes(), name, None)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows.append((int(bucket[a]), False, chunk, _packed(who[a:b]), _narrow(tokens[a:b]), None))
        for a in range(0, len(rows), 64):
            yield _rows(rows[a : a + 64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, held, seen = [], [], 0, set()
        for b in batches:
            for t in b.column(0).to_pylist():
                s = shingles(t, k)
                if not s.size or (key := set_key(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                keys.append(key)
                sets.append(s)
                held += s.size
                if held >= CHUNK:
                    yield from flush(keys, sets)
                    keys, sets, held = [], [], 0
        if keys:
            yield from flush(keys, sets)

    return docs.select("text").mapInArrow(run, DEALT)


def shared_only(parts: DataFrame, tasks: int) -> DataFrame:
    """Of each bucket the shingles that stand in more than one place, with the number of places (``seen``, 255 for
    more). A task holds one bucket at a time."""

    def told(bucket: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([_wide(low, bucket) for _, _, low in held])
        _, back, count = np.unique(tokens, return_inverse=True, return_counts=True)
        count = np.minimum(count, 255).astype(np.uint8)[back]
        at = 0
        for chunk, who, low in held:
            n = len(low) * 8 // LOW
            keep = np.flatnonzero(count[at : at + n] > 1)
            if keep.size:
                yield _rows([(bucket, False, chunk, _packed(_unpacked(who)[keep]), _narrow(tokens[at : at + n][keep]), count[at : at + n][keep].tobytes())])
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, head, chunk, who, low, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if head:
                    yield _rows([(bucket, True, chunk, who, low, None)])
                    continue
                if bucket != now and held:
                    yield from told(now, held)
                    held = []
                now = bucket
                held.append((chunk, who, low))
        if held:
            yield from told(now, held)

    return parts.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, DEALT)


def shared_sets(parts: DataFrame, percent: int) -> DataFrame:
    """``cls, n, tokens, seen`` of the sets that share enough of their shingles to link with anything: the shared
    ones, ascending, and the number of places of each."""

    def built(head: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes, name = np.frombuffer(head[0], "<u4").astype(np.int64), head[1]
        who = np.concatenate([_unpacked(w) for _, w, _, _ in held])
        tokens = np.concatenate([_wide(low, bucket) for bucket, _, low, _ in held])
        seen = np.concatenate([np.frombuffer(s, np.uint8) for _, _, _, s in held])
        count = np.bincount(who, minlength=len(sizes))
        stays = 100 * count >= percent * sizes
        keep = stays[who]
        who, tokens, seen = who[keep], tokens[keep], seen[keep]
        order = np.lexsort((tokens, who))
        tokens, seen, ends = tokens[order], seen[order], np.cumsum(count * stays)
        cols: list[list] = [[], [], [], []]
        for i in np.flatnonzero(stays).tolist():
            a, b = int(ends[i] - count[i]), int(ends[i])
            for col, x in zip(cols, (name[i * KEY : (i + 1) * KEY], int(sizes[i]), tokens[a:b].tobytes(), seen[a:b].tobytes()), strict=True):
                col.append(x)
            if len(cols[0]) == 256:
                yield _sets(cols)
                cols = [[], [], [], []]
        yield _sets(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, held = None, None, []
        for b in batches:
            for bucket, is_head, chunk, who, low, seen in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != now:
                    if held:
                        yield from built(head, held)
                    now, head, held = chunk, None, []
                if is_head:
                    head = (who, low)
                elif head is None:
                    raise RuntimeError("the documents came in another order when a task was repeated; write them to files first")
                else:
                    held.append((bucket, who, low, seen))
        if held:
            yield from built(head, held)

    def _sets(cols: list[list]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["cls", "n", "tokens", "seen"])

    by_chunk = parts.repartition("chunk").sortWithinPartitions("chunk", F.desc("head"))
    return by_chunk.mapInArrow(run, "cls binary, n int, tokens binary, seen binary").dropDuplicates(["cls"])


def index_lists(sets: DataFrame, percent: int) -> DataFrame:
    """``token, cls, n, pos, own``: the shared shingles by which a set must be found, rarest first; ``own`` is the
    number of its shingles that nothing shares, which come before them and have no list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[np.zeros(0, np.int64)], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]]
            for cls, n, tokens, seen in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens, seen = np.frombuffer(tokens, "<u8"), np.frombuffer(seen, np.uint8)
                own = n - len(tokens)
                first = max(0, n - -(-percent * n // 100) + 1 - own)
                front = tokens[np.lexsort((tokens, seen))[:first]]
                cols[0].append(front.view(np.int64))
                cols[1] += [cls] * len(front)
                for col, x in zip(cols[2:], (np.full(len(front), n), own + np.arange(len(front)), np.full(len(front), own)), strict=True):
                    col.append(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[0])), pa.array(cols[1], pa.binary()), *(pa.array(np.concatenate(c)) for c in cols[2:])], names=["token", "cls", "n", "pos", "own"])

    return sets.select("cls", "n", "tokens", "seen").mapInArrow(run, "token bigint, cls binary, n int, pos int, own int")


def reaches(n: str, m: str, pos: str, other: str, percent: int):
    """Whether sets of sizes n and m that first meet at these positions of a list can reach the threshold."""
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and (100 + {percent}) * least({n} - {pos}, {m} - {other}) >= {percent} * ({n} + {m})")


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each set (b) with the hub (a) of each of its lists."""
    hub = F.min_by(F.struct("cls", "n", "pos"), F.struct(F.col("own") / F.col("n"), "cls"))
    hubs = lists.groupBy("token").agg(hub.alias("hub"), F.count("*").alias("c")).where("c > 1").select("token", F.col("hub.cls").alias("a"), F.col("hub.n").alias("m"), F.col("hub.pos").alias("other"))
    return lists.join(hubs, "token").where("cls <> a").where(reaches("n", "m", "pos", "other", percent)).select("a", F.col("cls").alias("b")).distinct()


def index_pairs(lists: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs of sets of differing components that share a list and can still reach the threshold: first
    pairs of whole blocks, then the rows of those that are not skipped."""
    named = lists.join(known.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = named.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    rows = cut(named.join(mixed, "token", "left_semi").select("token", "comp", "n", "pos", "cls"), "jaccard-open")
    blocks = rows.select("token", "comp", "n", "pos").distinct()
    x = blocks.select("token", *(F.col(c).alias(f"{c}_x") for c in ("comp", "n", "pos")))
    y = blocks.select("token", *(F.col(c).alias(f"{c}_y") for c in ("comp", "n", "pos")))
    met = x.join(y, "token").where("comp_x < comp_y").where(reaches("n_x", "n_y", "pos_x", "pos_y", percent))
    side = lambda s, out: rows.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("comp", "n", "pos")), F.col("cls").alias(out))
    for s, out in (("x", "a"), ("y", "b")):
        met = met.join(side(s, out), ["token", f"comp_{s}", f"n_{s}", f"pos_{s}"])
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, na, nb, both``: sizes and overlap of each pair. The set of b meets that of a, which comes once for every
    FAN partners; a task holds one set of a at a time."""
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("copies"))
    own = sets.select("cls", "n", "tokens")
    hubs = fan.join(own, fan.a == own.cls).select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"), "n", "tokens")
    spread = pairs.join(fan, "a").select("a", F.expr("cast(pmod(xxhash64(b), copies) as int)").alias("salt"), "b")
    members = spread.join(own, spread.b == own.cls).select("a", "salt", "b", "n", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, size, of = None, 0, None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for a, salt, b, n, tokens in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                s = np.frombuffer(tokens, "<u8")
                if b is None:
                    hub, size, of = s, n, (a, salt)
                    continue
                if of != (a, salt):
                    raise RuntimeError("a hub's set is missing")
                for col, v in zip(out, (a, b, size, n, np.intersect1d(hub, s, assume_unique=True).size), strict=True):
                    col.append(v)
            kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["a", "b", "na", "nb", "both"])

    met = hubs.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return met.mapInArrow(run, "a binary, b binary, na int, nb int, both int")


def linked(answers: DataFrame, percent: int) -> DataFrame:
    return answers.where(f"(100 + {percent}) * both >= {percent} * (na + nb)").select("a", "b")


def derived(pairs: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """The pairs with ``link``: true or false where the answers of a hub that both were compared with decide it, else null.

    What a and b have in common is part of what both have in common with the hub, or lies outside it."""
    hub = answers.select("a", F.col("a").alias("b"), F.col("na").alias("nb"), "na", F.col("na").alias("both")).distinct()
    known = hub.unionByName(answers)
    side = lambda to: known.select(F.col("a").alias("hub"), F.col("b").alias(to), F.col("na").alias("nh"), F.col("nb").alias(f"n_{to}"), F.col("both").alias(f"o_{to}"))
    met = pairs.join(side("a"), "a").join(side("b").drop("nh"), ["hub", "b"])
    most = F.expr("least(o_a, o_b) + least(n_a - o_a, n_b - o_b)")
    bounds = met.groupBy("a", "b").agg(F.min(most).alias("most"), F.max(F.expr("o_a + o_b - nh")).alias("least"), F.first(F.col("n_a") + F.col("n_b")).alias("sum"))
    told = bounds.select("a", "b", F.expr(f"case when (100 + {percent}) * least >= {percent} * sum then true when (100 + {percent}) * most < {percent} * sum then false end").alias("link"))
    return pairs.join(told, ["a", "b"], "left")


def components(edges: DataFrame, label: str = "jaccard-components") -> DataFrame:
    """``node, comp``: the smallest node that each node of the edges (a, b) reaches, by alternating
    large and small stars until nothing changes. Ids only; each step is written down."""
    star = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    was = _digest(star)
    while True:
        both = star.union(star.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.expr("explode(array(struct(u as u, m as v), struct(v as u, m as v)))").alias("e")).select("e.*").where("u <> v").distinct()
        star = cut(small, label)
        now = _digest(star)
        if now == was:
            return star.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        was = now


def _digest(edges: DataFrame) -> tuple:
    """What tells whether a set of distinct edges has changed: their number and sums of two hashes."""
    parts = [F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", F.lit(1), "u").cast("decimal(38,0)"))]
    return tuple(edges.agg(F.count("*"), *parts).first())


def jaccard_join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    feats = cut(features(docs, k), "jaccard-features")
    total = feats.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, -(-total // BUCKET))
    # tasks grow with the input: a quarter of the buckets, but no fewer than shuffles have here
    tasks = max(buckets // 4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sets = cut(shared_sets(shared_only(dealt(docs, k, buckets), tasks), percent), "jaccard-sets")
    lists = cut(index_lists(sets, percent), "jaccard-lists")

    answers = cut(compared(hub_pairs(lists, percent), sets), "jaccard-answers")
    known = components(linked(answers, percent))
    pairs = cut(derived(index_pairs(lists, known, percent), answers, percent), "jaccard-pairs")
    more = linked(compared(pairs.where("link is null").select("a", "b"), sets), percent)
    edges = known.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(pairs.where("link").select("a", "b")).union(more)
    done = components(edges)

    classes = feats.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    ids = classes.join(done.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("comp", "cls").alias("comp"))
    low = ids.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = ids.join(low, "comp").select("cls", "component_id")
    out = feats.where("cls is not null").join(named, "cls").select("doc_id", "n_shingles", "component_id")
    return out.union(feats.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
