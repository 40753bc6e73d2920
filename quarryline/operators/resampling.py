"""Paired bootstrap intervals with weights that anyone can recompute, and the exact binomial test in closed form.

A draw gives every item a weight from a counter-based generator: a digest of seed, item and draw, read as a number, picks
from the Poisson distribution of mean one, which is how often an item comes up in a resample of many. So a weight is the same
wherever and whenever it is computed, for all methods that an item pairs, and a draw is one weighted sum, combined
map-side: memory follows the number of draws, not items, and no row is sampled away."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

try:  # the interpreter's own, which takes half the time of OpenSSL's for a few bytes
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: Weights from one digest: eight hexadecimal digits each.
PER_DIGEST = 4


def _thresholds(most: int = 12) -> list[int]:
    """Numbers below 2^32 from which a weight is 1, 2, ..."""
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(round(total * 2**32))
    return [t for t in out if t < 2**32]


THRESHOLDS = _thresholds()


def weights(key: str = "job_id", draws: int = 200, seed: int = 42) -> Column:
    """An array of ``draws`` weights of the row's item."""
    digests = F.transform(F.sequence(F.lit(0), F.lit((draws - 1) // PER_DIGEST)), lambda b: F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), b.cast("string"))))
    numbers = F.flatten(F.transform(digests, lambda d: F.array(*(F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(PER_DIGEST)))))
    weight = lambda u: reduce(Column.__add__, [(u >= t).cast("int") for t in THRESHOLDS])
    return F.slice(F.transform(numbers, weight), 1, draws)


_DRAWN = "metric string, method string, draw int, num double, den double, bnum double, bden double, n double"
#: The draw that is none: every item once.
WHOLE = -1


def _weighted(draws: int, seed: int, whole: bool = False):
    """Rows ``key, metric, method, num, den, bnum, bden`` to the sums of each draw that the task's rows have any weight in, by metric and
    method, and to those of every row once if ``whole``: the weights of ``weights``, a batch of items at once. An item's rows are
    added up first, so its weights are drawn once a batch, whatever its metrics and methods. Memory follows draws and methods, not rows."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [f":{b}".encode() for b in range(-(-draws // PER_DIGEST))]
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, metrics, methods = (batch.column(i).dictionary_encode() for i in range(3))
            digests = []
            for k in keys.dictionary.to_pylist():
                head = md5(f"{seed}:{k}".encode(), usedforsecurity=False)
                for block in blocks:
                    h = head.copy()
                    h.update(block)
                    digests.append(h.digest())
            numbers = np.frombuffer(b"".join(digests), dtype=">u4").reshape(len(keys.dictionary), -1)[:, :draws].astype(np.uint32)
            weight = np.zeros(numbers.shape, np.uint8)
            for least in THRESHOLDS:
                weight += numbers >= least
            weight = np.column_stack([weight.astype(np.float64), np.ones(len(weight))])
            names = list(itertools.product(metrics.dictionary.to_pylist(), methods.dictionary.to_pylist()))
            cell = (keys.indices.to_numpy().astype(np.int64) * len(metrics.dictionary) + metrics.indices.to_numpy()) * len(methods.dictionary) + methods.indices.to_numpy()
            values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7)] + [np.ones(batch.num_rows)]
            sums = [weight.T @ np.bincount(cell, v, len(weight) * len(names)).reshape(len(weight), len(names)) for v in values]
            for i, name in enumerate(names):
                total[name] = total.get(name, 0.0) + np.column_stack([s[:, i] for s in sums])
        for (metric, method), sums in total.items():
            hit = np.flatnonzero(sums[: draws + whole, 4] > 0)
            same = lambda x: pa.array([x] * len(hit), pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(metric), same(method), pa.array(np.where(hit < draws, hit, WHOLE).astype(np.int32)), *(pa.array(np.ascontiguousarray(sums[hit, c])) for c in range(5))], names=["metric", "method", "draw", "num", "den", "bnum", "bden", "n"])

    return told


def cells(items: DataFrame, metrics: dict[str, tuple[Column, Column]], key: str = "job_id") -> DataFrame:
    """``key, method, cells``: each metric as a ratio of sums over items, ``cells.<metric>.num`` and ``.den``."""
    each = F.struct(*(F.struct(n.cast("double").alias("num"), d.cast("double").alias("den")).alias(m) for m, (n, d) in metrics.items()))
    return items.select(key, "method", each.alias("cells"))


def mean(column: str) -> tuple[Column, Column]:
    return F.col(column).cast("double"), F.when(F.col(column).isNotNull(), 1.0)


def micro_f1(scope: str) -> tuple[Column, Column]:
    tp, fp, fn = (F.col(f"{scope}_{c}") for c in ("tp", "fp", "fn"))
    return 2 * tp, 2 * tp + fp + fn


def paired(ratios: DataFrame, baseline: str, key: str) -> DataFrame:
    """``key, metric, method, num, den, bnum, bden``: each method's cell beside the baseline's, of items for which the baseline has
    just one. Rows meet by a window over the key alone, before metrics become rows, so those that lie by key already are neither
    exchanged nor sorted. A row without a key is no item."""
    by, own = Window.partitionBy(key), F.col("method") == baseline
    metrics = ratios.schema["cells"].dataType.names
    whole = {m: F.col(f"cells.`{m}`.num").isNotNull() & F.col(f"cells.`{m}`.den").isNotNull() for m in metrics}
    beside = {f"_b{i}": F.struct(*(F.max(F.when(own & whole[m], F.col(f"cells.`{m}`.{c}"))).over(by).alias(f"b{c}") for c in ("num", "den")), F.count_if(own & whole[m]).over(by).alias("bases")) for i, m in enumerate(metrics)}
    met = ratios.where(F.col(key).isNotNull()).withColumns(beside).where(F.col("method") != baseline)
    rows = [F.struct(F.lit(m).alias("metric"), *(F.col(f"cells.`{m}`.{c}").alias(c) for c in ("num", "den")), *(F.col(f"_b{i}.{c}").alias(c) for c in ("bnum", "bden", "bases"))) for i, m in enumerate(metrics)]
    return met.select(key, "method", F.inline(F.array(*rows))).where("bases = 1 and num is not null and den is not null").select(key, "metric", "method", "num", "den", "bnum", "bden")


def bootstrap(ratios: DataFrame, baseline: str, draws: int = 200, seed: int = 42, empty: float = 1.0, key: str = "job_id") -> DataFrame:
    """``method, metric, n, difference, ci_low, ci_high, excludes_zero``: each method's ratio of sums less the
    baseline's, with a 95 % percentile interval, over items that both have (``ratios``: see ``cells``; null leaves a pair
    out). A ratio of nothing is ``empty``. Items are read once, for the draws and the whole alike."""
    both = paired(ratios, baseline, key).withColumn(key, F.col(key).cast("string"))
    drawn = both.mapInArrow(_weighted(draws, seed, True), _DRAWN)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(empty))
    difference = ratio("num", "den") - ratio("bnum", "bden")
    sums = drawn.groupBy("metric", "method", "draw").agg(*(F.sum(c).alias(c) for c in ("num", "den", "bnum", "bden", "n"))).select("metric", "method", "draw", "n", difference.alias("difference"))
    of_all, spread = F.col("draw") == WHOLE, F.sort_array(F.collect_list(F.when(F.col("draw") != WHOLE, F.col("difference"))))  # a number a draw
    found = sums.groupBy("metric", "method").agg(F.max(F.when(of_all, F.col("n"))).cast("bigint").alias("n"), F.max(F.when(of_all, F.col("difference"))).alias("difference"), spread.alias("_spread"))

    def end(q: float) -> Column:
        """The interpolated quantile of the draws."""
        place = (F.size("_spread") - 1) * F.lit(q)
        low, high = (F.get("_spread", f(place).cast("int")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    out = found.select("metric", "method", "n", "difference", end(0.025).alias("ci_low"), end(0.975).alias("ci_high")).where("ci_low is not null")
    return out.withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


# --- the exact test ------------------------------------------------------------------------------------

#: ln n! less Stirling's formula, for small n.
_SMALL = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]


def _rest(n: Column) -> Column:
    """ln n! less Stirling's formula."""
    v = F.greatest(n.cast("double"), F.lit(1.0))
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / (v * v)) / (v * v)) / (v * v)) / (v * v)) / v
    return F.when(n < len(_SMALL), F.element_at(F.array(*map(F.lit, _SMALL)), (F.least(n, F.lit(len(_SMALL) - 1)) + 1).cast("int"))).otherwise(series)


def binomial_two_sided(a: Column, b: Column) -> Column:
    """The exact test that a coin which fell a times on one side and b times on the other is fair: twice the smaller tail.

    The tail is the incomplete beta function at a half: its largest term, from the deviance and the rests of Stirling's formula
    (nothing cancels or overflows, however large the counts), times a continued fraction. That takes some roots of
    n steps at most, whose numbers are all that is held."""
    a, b = a.cast("bigint"), b.cast("bigint")
    n, k = a + b, F.least(a, b)
    nd, kd = n.cast("double"), k.cast("double")
    u = (nd - 2 * kd) / nd
    deviance = nd / 2 * ((1 - u) * F.log1p(-u) + (1 + u) * F.log1p(u))
    top = F.sqrt(nd / (2 * math.pi * kd * (nd - kd))) * F.exp(_rest(n) - _rest(k) - _rest(n - k) - deviance)
    p, q = nd - kd, kd + 1  # the tail is I(1/2; p, q)
    steps = F.sequence(F.lit(1), F.least(k + 1, F.ceil(8 * F.sqrt(nd)) + 60).cast("int"))
    kind = "struct<c double, d double, h double>"
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h")).cast(kind)

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (q - m) * 0.5 / ((p - 1 + 2 * m) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * 0.5 / ((p + 2 * m) * (p + 1 + 2 * m))
        d1, c1 = 1 / (1 + even * s["d"]), 1 + even / s["c"]
        d2, c2 = 1 / (1 + odd * d1), 1 + odd / c1
        return state(c2, d2, s["h"] * d1 * c1 * d2 * c2)

    first = 1 / (1 - (p + q) * 0.5 / (p + 1))
    fraction = F.aggregate(steps, state(F.lit(1.0), first, first), step, lambda s: s["h"])
    tail = F.when(k == 0, F.exp(-nd * math.log(2.0))).otherwise(top / 2 * fraction)
    return F.when(n == 0, 1.0).when(a == b, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
