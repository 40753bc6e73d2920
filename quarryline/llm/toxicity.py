"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

A sentence is a bag of units: its blank-separated words, and runs of single characters read as one
unit ("i d i o t"). The kernel of two units compares all their subsequences of three characters, each
occurrence weighted by DECAY to the power of its span, so gaps and inserted characters cost little and
do not hide a word. Spans are bounded, so the kernel has an explicit sparse feature map and a unit is
compared with all landmarks by a few look-ups. Landmarks are the units that account for the toxic labels,
the most frequent others and those that come nearest to the former; the inverse root of their kernel matrix maps
a unit to a short vector, on which a linear support vector machine is trained. The machine decides on
every unit. A sentence scores as its worst unit, a text as its worst sentence.

A label holds for a whole text, so training first tells which of a toxic text's units account for it: one that
comes in toxic texts almost only, and not merely beside more frequent such units (as in copies of one
text). These are the positive examples, with variants that have gaps and inserted characters; the units of
texts that aren't toxic are the negative ones, each with the number of its texts. Units of toxic texts that account
for nothing are in neither class. Counts come from a bounded hash sample of labelled rows (Spark);
what goes to the driver is bounded by that sample and the parameters. Scoring is one pass without a shuffle.

Null and empty texts score as a text without known units; without training rows all score 0. Repeated rows get equal
scores (and count each in training); further columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, bound_batches, cut, map_texts
from .language import hash_sample, held_out

SAMPLE_ROWS = 8_000
UNITS = 10_000
LANDMARKS = 128
#: Toxic texts in which a unit must occur to account for labels, and how many times more often than in others.
LEAST, TIMES = 4, 3
#: The string kernel enters as exp(SHARP (k - 1)), so that likeness counts and sharing a syllable hardly.
SHARP = 10.0
DECAY = 0.8
SPAN = 6
CHARS = 40  # a unit's window: longer words are read as overlapping windows
#: Margins below this are not told apart: nothing that scores so low is near the border.
FLOOR = -0.2
_UNIT = re.compile("[^\t-\r ]+")
_SINGLES = re.compile("(?<![^\t-\r ])[^\t-\r ](?:[\t-\r ][^\t-\r ]){2,}(?![^\t-\r ])")
_EDGE = ".,;:!?\"'()[]|"
# symbols of the bounds' tables: 0 parts units, 1 is a gap, letters, the rest
_SYMBOL = np.array([0 if 9 <= c <= 13 or c == 32 else c - 95 if 97 <= c <= 122 else 30 if 48 <= c <= 57 else 31 if c > 127 else 1 for c in range(129)], np.uint8)


def units(text: str | None) -> set[str]:
    text = (text or "").lower()
    return {u for w in _UNIT.findall(text) if len(u := w.strip(_EDGE)) > 2} | joined(text)


def joined(text: str) -> set[str]:
    return {"".join(run.split()) for run in _SINGLES.findall(text)}


def subsequences(unit: str) -> dict[str, float]:
    """The kernel's feature map: subsequences of three characters and their weights."""
    out: dict[str, float] = {}
    letter = [c.isalnum() or c > "\x7f" for c in unit]  # other characters are gaps only
    for i in range(len(unit) - 2):
        if not letter[i]:
            continue
        for j, k in combinations([x for x in range(i + 1, min(len(unit), i + SPAN)) if letter[x]], 2):
            u = unit[i] + unit[j] + unit[k]
            out[u] = out.get(u, 0.0) + DECAY ** (k - i)
    return out


class Kernel:
    """Nyström features of units: normalised kernel values with the landmarks times the inverse
    root of the landmarks' own matrix."""

    def __init__(self, landmarks: list[str]):
        maps = [subsequences(x) for x in landmarks]
        self.size = len(landmarks)
        #: One row a subsequence: its share in each landmark.
        self.place = {u: i for i, u in enumerate(dict.fromkeys(u for m in maps for u in m))}
        self.shares = np.zeros((len(self.place), self.size), np.float32)
        for j, m in enumerate(maps):
            norm = math.sqrt(sum(v * v for v in m.values())) or 1.0
            for u, v in m.items():
                self.shares[self.place[u], j] = v / norm
        gram = np.array([self.sharp(x) for x in landmarks], float).reshape(self.size, self.size)
        w, v = np.linalg.eigh((gram + gram.T) / 2 + 1e-6 * np.eye(self.size))
        self.root = (v / np.sqrt(np.maximum(w, 1e-6))) @ v.T

    def values(self, unit: str) -> np.ndarray:
        own, place = subsequences(unit), self.place
        known = [u for u in own if u in place]
        out = np.array([own[u] for u in known], np.float32) @ self.shares[[place[u] for u in known]] if known else np.zeros(self.size)
        return out / (math.sqrt(sum(v * v for v in own.values())) or 1.0)

    def sharp(self, unit: str) -> np.ndarray:
        return np.exp(SHARP * (self.values(unit) - 1.0))

    def features(self, unit: str) -> np.ndarray:
        return self.sharp(unit) @ self.root


def fit_svm(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, c: float = 10_000.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine on weighted examples by Newton steps on the active set."""
    # an example stands in a row for each class in which it has weight
    own = [np.flatnonzero(pos), np.flatnonzero(neg)]
    rows = np.concatenate(own)
    y = np.concatenate([np.ones(len(own[0])), -np.ones(len(own[1]))])
    xx = np.ones((len(rows), x.shape[1] + 1), x.dtype)
    np.take(x, rows, axis=0, out=xx[:, :-1])
    weight = np.concatenate([pos[own[0]], neg[own[1]]]).astype(float)
    weight /= weight.sum()
    w, ridge = np.zeros(xx.shape[1]), np.diag([1.0 / c] * x.shape[1] + [1e-9])
    for _ in range(steps):
        active = weight * (y * (xx @ w) < 1)
        scaled = xx * active[:, None]
        new = np.linalg.solve(ridge + scaled.T @ xx, scaled.T @ y)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def accounting(bags: list[frozenset], toxic: Counter, other: Counter) -> list[str]:
    """The units that account for toxic labels, the most telling first: frequent and almost only in toxic texts, and
    in half of these without a unit that is three times as frequent."""
    where: dict[str, set[int]] = {}
    for i, bag in enumerate(bags):
        for u in bag:
            where.setdefault(u, set()).add(i)
    out: list[str] = []
    for u in sorted(where, key=lambda u: (TIMES * other[u] - toxic[u], u)):
        if toxic[u] >= LEAST and toxic[u] > TIMES * other[u]:
            alone = where[u].difference(*(where[v] for v in out if toxic[v] >= 3 * toxic[u]))
            if len(alone) > 1 and 2 * len(alone) >= len(where[u]):
                out.append(u)
    return out


class Scorer:
    def __init__(self, counts: list[tuple[str, int, int]], bags: list[frozenset], landmarks: int = LANDMARKS):
        """counts: unit, toxic rows, other rows; bags: of each toxic row the units that may account for it."""
        self.kernel = None
        toxic, other = Counter({u: p for u, p, _ in counts}), Counter({u: n for u, _, n in counts})
        self.typical = typical = accounting(bags, toxic, other)
        plain = [u for u, p, n in counts if n and not (p > 1 and p > n)]
        if not typical or not plain:
            return
        near = Kernel(typical)
        close = {u: float(near.values(u).max()) for u in plain}
        common = sorted(plain, key=lambda u: (-other[u], u))[: landmarks // 4]
        hard = sorted(plain, key=lambda u: (-(close[u] ** 2) * math.log1p(other[u]), u))[:landmarks]
        self.kernel = Kernel([*typical, *common, *(u for u in hard if u not in common)])
        varied = [(t[:i] + c + t[i:], t) for t in typical for i in range(1, len(t)) for c in ".-*xe"] + [(c.join(t), t) for t in typical for c in ".-*"]
        feats = np.array([self.kernel.features(u) for u in [*typical, *(v for v, _ in varied), *plain]], np.float32)
        weight = {t: math.sqrt(toxic[t]) for t in typical}
        pos = np.array([3.0 * weight[t] for t in typical] + [4.0 * weight[t] / len(t) for _, t in varied] + [0.0] * len(plain))
        # an accounting unit is a negative example, too, so far as other texts have it
        neg = np.array([float(other[t]) for t in typical] + [0.0] * len(varied) + [other[u] * (0.02 + close[u] ** 4) for u in plain])
        self.weights, self.bias = fit_svm(feats, 0.1 * pos / pos.sum(), neg / neg.sum())
        self.direct = self.kernel.root @ self.weights
        self._bounds()

    def _bounds(self) -> None:
        """Two weights for each subsequence: its highest in a landmark that speaks for toxic, and the sum
        over these landmarks by their share in the margin. Summed over a unit and divided by the least norm of
        so many letters, they bound the highest kernel value and the sum of all from above."""
        speak = np.maximum(self.direct, 0.0)
        high, total = np.zeros((32, 32, 32), np.float32), np.zeros((32, 32, 32), np.float32)
        for u, i in self.kernel.place.items():
            at, row = tuple(_SYMBOL[min(ord(c), 128)] for c in u), self.kernel.shares[i]
            high[at] = max(high[at], row[speak > 0].max(initial=0.0))
            total[at] = max(total[at], float(row @ speak))
        self.high, self.total, self.all = high.ravel(), total.ravel(), float(speak.sum())
        self.least = np.array([math.sqrt(sum(DECAY ** (2 * (k - i)) for i in range(n - 2) for _, k in combinations(range(i + 1, min(n, i + SPAN)), 2))) or 1e-9 for n in range(CHARS + 1)])

    def suspects(self, text: str) -> set[str]:
        """All units whose margin can reach FLOOR (lower-cased text)."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = _SYMBOL[np.minimum(code, 128)]
        alone = np.flatnonzero((sym > 0) & np.append(True, sym[:-1] == 0) & np.append(sym[1:] == 0, True))
        out = joined(text) if len(alone) > 2 and (alone[2:] - alone[:-2] == 4).any() else set()
        starts = np.flatnonzero((sym > 0) & np.append(True, sym[:-1] == 0))
        if not len(starts):
            return out
        ends = np.flatnonzero((sym > 0) & np.append(sym[1:] == 0, True)) + 1
        n = len(sym)
        pad = np.append(sym, np.zeros(SPAN, sym.dtype)).astype(np.int32)
        far = [pad[d : n + d] for d in range(SPAN)]
        inside = [far[0] > 0]
        for d in range(1, SPAN):
            inside.append(inside[-1] & (far[d] > 0))
        high, total = np.zeros(n, np.float32), np.zeros(n, np.float32)
        first = far[0] << 10
        for j in range(1, SPAN - 1):
            pair = first | far[j] << 5
            for k in range(j + 1, SPAN):
                at, weight = pair | far[k], inside[k] * np.float32(DECAY**k)
                high += self.high[at] * weight
                total += self.total[at] * weight
        size = np.add.reduceat((sym > 1).astype(np.int32), starts)
        runs = np.add.reduceat(((sym > 1) & np.append(True, sym[:-1] <= 1)).astype(np.int32), starts)
        least = self.least[np.minimum(size, CHARS)]
        top = np.clip(np.add.reduceat(high, starts) / least, 1e-6, 1.0)
        # exp is convex: up to ``top`` it lies below its chord
        most = self.bias + math.exp(-SHARP) * self.all + np.exp(SHARP * (top - 1.0)) / top * np.add.reduceat(total, starts) / least
        maybe = (runs > 1) | (size > CHARS) | (most >= FLOOR - 1e-3)
        for a, b in zip(starts[maybe], ends[maybe], strict=True):
            out.add(text[a:b].strip(_EDGE))
        return out

    def margin(self, unit: str) -> float:
        letters = "".join(c for c in unit if c.isalnum() or c > "\x7f")  # the gaps closed as well
        return max(self._margin(p) for u in {unit, letters} for p in pieces(u))

    def _margin(self, unit: str) -> float:
        return float(self.kernel.sharp(unit) @ self.direct + self.bias)

    def score(self, text: str | None, cache: Recent) -> float:
        if self.kernel is None:
            return 0.0
        worst = max([cache[u] for u in self.suspects((text or "").lower()) if len(u) > 2], default=FLOOR)
        return 1.0 / (1.0 + math.exp(-3.0 * max(FLOOR, min(9.0, worst))))


def pieces(unit: str) -> list[str]:
    """A unit as windows of at most CHARS characters."""
    return [unit[i : i + CHARS] for i in range(0, max(1, len(unit) - CHARS // 2), CHARS // 2)]


def unit_counts(labelled: DataFrame, most: int = UNITS) -> tuple[list[tuple[str, int, int]], list[frozenset]]:
    """Counts of the most frequent units (about ``most`` of them) and of all that may account for labels, and these by toxic row."""
    bound_batches(labelled.sparkSession)

    def run(batches):
        for b in batches:
            for row, text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = sorted({p for u in units(text) for p in pieces(u)})
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(own), pa.int64()), pa.array(own, pa.string()), pa.array([toxic] * len(own), pa.int32())], names=["row", "unit", "toxic"])

    named = labelled.select(F.xxhash64("doc_id", "text").alias("row"), "text", F.col("toxic").cast("int"))
    rows = cut(named.mapInArrow(run, "row bigint, unit string, toxic int"), "toxicity-units")
    both = rows.groupBy("unit").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    telling = f"p >= {LEAST} and p > {TIMES} * n"
    # the frequency from which on units are as many as wanted; frequencies are no more than sampled rows
    wanted, least = 0, 1
    for c, n in sorted(((r[0], r[1]) for r in both.groupBy((F.col("p") + F.col("n")).alias("c")).count().collect()), reverse=True):
        wanted += n
        if wanted > most:
            least = c + 1
            break
    counts = both.where(f"p + n >= {least} or ({telling})").collect()
    bags = rows.where("toxic = 1").join(both.where(telling).select("unit"), "unit").groupBy("row").agg(F.collect_set("unit")).collect()
    return sorted(tuple(r) for r in counts), [frozenset(r[1]) for r in sorted(bags)]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Learns from the labelled rows that are not held out."""
    marked = labels.where("toxic in (0, 1)").where(~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hash_sample(marked, sample_rows, "doc_id")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # the sample is bounded by its parameter (16 bytes a row), so it may be broadcast
    return Scorer(*unit_counts(texts.join(F.broadcast(chosen), "doc_id")))


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id") -> DataFrame:
    """``key, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def make():
        own = shared.value
        cache = Recent(own.margin, 300_000)

        def fn(_, texts):
            return [pa.array([own.score(t, cache) for t in texts], pa.float64())]

        return fn

    return map_texts(docs, make, "score double", key)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The thin query."""
    got = score(docs, train(docs, labels))
    return got.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with all their columns; one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    place = docs.columns.index("text")
    bound_batches(docs.sparkSession)

    def run(batches):
        own = shared.value
        cache = Recent(own.margin, 300_000)
        for b in batches:
            yield b.filter(pa.array([own.score(t, cache) < threshold for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
