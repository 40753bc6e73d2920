"""Rank selection, split CSV files, pattern tables, contracts, comparisons, reply caches, layers and resampling."""

import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline import functions as Q
from quarryline.operators import columns as L
from quarryline.operators import contracts as J
from quarryline.operators import patterns as P
from quarryline.operators import reconcile as R
from quarryline.operators import replies as A
from quarryline.operators import resampling as B
from quarryline.operators import scoring as C
from quarryline.plans import tables as T
from quarryline.sources import csvscan, files, layers

SMALL = "/root/testdata/sf0.001"


# --- quantiles -------------------------------------------------------------------------------------

WANTED = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.975, "e": 1.0}


def test_quantiles_of_one_key_with_distinct_values(spark):
    """Nobody sorts more than an eighth of the rows, and the results are those of a whole sort."""
    n = 200_000
    df = spark.range(n).select(((F.col("id") * 7919) % n * 2.45 + 10_000).alias("v"))
    counted = df.groupBy(F.col("v").alias("_v")).agg(F.count("*").alias("_n"))
    sizes, near = Q.rank_buckets(counted, [], WANTED)
    assert sizes.count() <= n / 8 and near.count() <= n / 8
    want = np.quantile(np.arange(n) * 2.45 + 10_000, list(WANTED.values()))
    assert list(Q.quantiles(df, [], "v", WANTED, None).first()) == pytest.approx(list(want), rel=1e-12)


def test_quantiles_of_odd_values(spark):
    rng = random.Random(3)
    some = [0.0, -0.0, 1e-300, -1e-300, 5e-324, 1.0, -1.0, 1e300, -1e300, 2.0, 3.0, 0.1, 1 / 3, 1e15, 1e15 + 1]
    rows = [(k, v) for k in ("x", "y", None) for v in rng.choices(some, k=400)] + [("one", 7.5), ("none", None), ("many", 1.0), ("many", None)]
    got = {r.k: list(r)[1:] for r in Q.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", WANTED, None).collect()}
    assert set(got) == {"x", "y", None, "one", "many"}
    for k, values in got.items():
        assert values == pytest.approx(list(np.quantile([v for i, v in rows if i == k and v is not None], list(WANTED.values()))), rel=1e-12)
    assert list(Q.quantiles(spark.createDataFrame(rows, "k string, v double").where("false"), [], "v", WANTED).first()) == [None] * 5
    top = spark.createDataFrame([(float("inf"),), (float("nan"),), (-float("inf"),), (1.0,), (2.0,)], "v double")
    assert Q.quantiles(top, [], "v", {"m": 0.5, "low": 0.25}, None).first()[:] == (2.0, 1.0)


def test_buckets_never_fall(spark):
    rng = random.Random(5)
    values = sorted({s * m * 2.0**e for s in (1, -1) for e in range(-60, 60) for m in (1.0, 1.25, 1.9999999, 1 + rng.random())} | {0.0})
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", Q.value_bucket(F.col("v")).alias("b")).orderBy("i").select("b").collect()]
    assert got == sorted(got) and len(set(got)) > 400


# --- CSV ---------------------------------------------------------------------------------------------

def _csv(path, rows, end="\n"):
    quote = lambda x: x if x and not set(x) & set('",\r\n') else f'"{x.replace(chr(34), chr(34) * 2)}"'
    path.write_bytes((end.join(",".join(map(quote, r)) for r in rows) + end).encode())


def _whole(spark, path, schema):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path, schema=schema)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_is_split_at_every_byte(spark, tmp_path, end):
    rng = random.Random(11)
    part = ["a", "é", '"', '""', "\n", ",", "\n\n", " ", "x" * 9, '"\n"', ""]
    rows = [["id", "text", "n"], *([str(i), "".join(rng.choices(part, k=rng.randint(0, 6))), str(i * 3)] for i in range(60)), ["60", "\n" * 150, "1"], ["61", 'end"', "2"]]
    _csv(tmp_path / "p.csv", rows, end)
    path, schema = f"file://{tmp_path}/p.csv", "id int, text string, n int"
    want = sorted(map(tuple, _whole(spark, path, schema).collect()), key=repr)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in (9, 64, 101, 100_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            if size < 1000:
                assert csvscan.lines_of(spark, path).rdd.getNumPartitions() > 8
            assert sorted(map(tuple, csvscan.scan(spark, path, schema).collect()), key=repr) == want, size
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_csv_of_several_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in "abc":
        _csv(tmp_path / "d" / f"{name}.csv", [["k", "v", "w", "t"], [name, "1", "1.5", "2024-01-02 03:04:05"], ["two\nlines", "3000000000", "", ""], ["k", "v", "", ""]][: 4 if name == "a" else 3])
    got = csvscan.scan(spark, f"file://{tmp_path}/d", "k string, v string, w string, t string")
    assert sorted(r.k for r in got.collect()) == ["a", "b", "c", "k", "two\nlines", "two\nlines", "two\nlines"]
    assert dict(csvscan.scan(spark, f"file://{tmp_path}/d/b.csv").dtypes) == {"k": "string", "v": "bigint", "w": "double", "t": "timestamp"}
    (tmp_path / "open.csv").write_text('k,v\n1,"never\nends\n')
    with pytest.raises(Exception, match="has no end"):
        csvscan.scan(spark, f"file://{tmp_path}/open.csv", "k string, v string").collect()
    with pytest.raises(ValueError, match="columns are wanted"):
        csvscan.scan(spark, f"file://{tmp_path}/d/b.csv", "k string")


# --- patterns ---------------------------------------------------------------------------------------

@pytest.mark.parametrize(("pattern", "want"), [
    (r"(?i)(^|[^a-z0-9])sql([^a-z0-9]|$)", ["sql"]), (r"power\s*bi", ["power"]), ("(github|gitlab|git)", ["git"]), ("a?b*", None), ("(x|)", None), (r"\d+", None), ("colou?r", ["colo"]), ("(abc)+", ["abc"]), ("(abc)*d", ["d"]), ("big query|r", ["query", "r"]), ("(", None), ("(?=look)ab", ["ab"]), ("É+tude", ["tude"]),
])
def test_needed_words(pattern, want):
    assert P.needed(pattern) == want


def test_patterns_equal_the_nested_loop(spark):
    rng = random.Random(2)
    words = ["sql", "SQL", "python", "r", "git-hub", "GitHub", "power  bi", "big\nquery", "mysql", "x1", "ÉTUDE", "étude", "", "color", "colour", "9"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 8)))) for i in range(120)] + [(900, None), (901, "")]
    rules = [r"(?i)(^|[^a-z0-9])sql([^a-z0-9]|$)", "sql", r"power\s*bi", r"(?i)git-?hub|python", r"\bR\b", "colou?r", r"\d+", r"big\s+query", "(?i)étude", "É", "z", "", None]
    t, p = spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(list(enumerate(rules)), "j int, p string")
    got = sorted(map(tuple, P.matches(t, p, "i", "t", "j", "p").collect()))
    want = sorted(map(tuple, t.crossJoin(p).where(F.expr("t rlike p")).select("i", "j").collect()))
    assert got == want and len(got) > 200


def test_many_patterns_do_not_grow_the_plan(spark):
    plans = []
    for n in (10, 10_000):
        rules = spark.range(n).select("id", F.concat(F.lit("(?i)w"), F.col("id"), F.lit(r"\s+v")).alias("p"))
        texts = spark.range(200).select(F.col("id").alias("i"), F.concat_ws(" ", F.lit("W"), F.concat(F.lit("w"), F.col("id") * 50), F.lit("v")).alias("t"))
        got = P.matches(texts, rules, "i", "t", "id", "p")
        if n == 10_000:
            assert sorted(map(tuple, got.collect())) == [(i, i * 50) for i in range(200)]
        plans.append(got._jdf.queryExecution().sparkPlan().toString())
    assert len(re.findall("Join", plans[0])) == len(re.findall("Join", plans[1])) and len(plans[1]) < 1.2 * len(plans[0])
    assert "NestedLoop" not in plans[1].split("Union")[0] and "Cartesian" not in plans[1]


# --- contracts ---------------------------------------------------------------------------------------

def test_join_contracts(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (None, 0)], "k int, y int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(J.join(left, right, ["k"], matched="met").select("k", "x", "y", "met")) == sorted([(1, "a", 10, True), (2, "b", 20, True), (2, "c", 20, True), (None, "d", None, False), (None, "e", None, False)], key=repr)
    assert rows(J.join(left, right, ["k"], misses="drop").select("x")) == [("a",), ("b",), ("c",)]
    with pytest.raises(Exception, match="left side has several rows of k=2"):
        J.join(left, right, ["k"], "one_to_one").collect()
    with pytest.raises(Exception, match="right side has several rows of k=2"):
        J.join(right, left, ["k"], "many_to_one").collect()
    assert J.join(right.where("k is not null"), left, ["k"], "one_to_many", "keep").count() == 4
    with pytest.raises(Exception, match="no match on the right for k=3"):
        J.join(right.where("k is not null"), left, ["k"], "one_to_many", "fail").collect()
    with pytest.raises(Exception, match="no match on the left for k=3"):
        J.join(left.where("k is not null"), right.where("k is not null"), ["k"], "many_to_one", "fail_both").collect()
    with pytest.raises(J.ContractError, match="both sides"):
        J.join(left, left, ["k"])
    with pytest.raises(J.ContractError, match="unknown"):
        J.join(left, right, ["k"], "some_to_some")
    got, seen = J.observed(left, right, ["k"], "seen")
    assert got.count() == 5 and seen.get == {"rows": 5, "misses": 2}


def test_unique_side_needs_no_further_exchange(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = (spark.range(100).select((F.col("id") % m).alias("k"), F.col("id").alias(n)) for m, n in ((50, "x"), (100, "y")))
        plain = left.join(right, "k")._jdf.queryExecution().executedPlan().toString()
        checked = J.join(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()
        assert checked.count("Exchange") == plain.count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_same_ids_and_complete_grids(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k int")
    assert sorted(r.k for r in J.same_ids({"a": ids(1, 2), "b": ids(2, 1)}, "k").collect()) == [1, 2]
    for bad, message in ((ids(1), "k=2: b has 0"), (ids(1, 2, 2), "k=2: b has 2"), (ids(1, 2, 3), "k=3: a has 0")):
        with pytest.raises(Exception, match=message):
            J.same_ids({"a": ids(1, 2), "b": bad}, "k").collect()
    groups = spark.createDataFrame([("m",), ("n",)], "g string")
    items = spark.createDataFrame([(1, "m", 5), (2, "n", None)], "k int, g string, v int")
    assert sorted(map(tuple, J.complete(items, ids(1, 2), groups, "k", "g").select("k", "g", "v", "missing").collect())) == [(1, "m", 5, False), (1, "n", None, True), (2, "m", None, True), (2, "n", None, False)]
    with pytest.raises(Exception, match="right side has several"):
        J.complete(items.union(items), ids(1, 2), groups, "k", "g").collect()


# --- comparisons --------------------------------------------------------------------------------------

def test_differences(spark):
    schema = "k int, s string, v double"
    a = [(i, f"s{i % 5}", i / 7) for i in range(500)] + [(None, "n", 0.0), (900, "r", 1.0), (900, "r", 1.0), (901, "t", 1.0), (901, "t", 2.0), (902, None, float("nan"))]
    b = [(k, "x" if k == 3 else s, v + 1 if k in (3, 4) else v * (1 + 1e-14) if (k or 900) < 900 else v) for k, s, v in a if k != 7] + [(1000, "new", None), (901, "t", 1.0)]
    x, y = (spark.createDataFrame(random.Random(1).sample(r, len(r)), schema) for r in (a, b))
    got = {(r.k, r.status, r["columns"], r.left_rows, r.right_rows) for r in R.differences(x, y, ["k"], ranges=64).collect()}
    assert got == {(3, "changed", "s,v", 1, 1), (4, "changed", "v", 1, 1), (7, "left_only", None, 1, 0), (1000, "right_only", None, 0, 1), (901, "repeated", None, 2, 3)}
    assert R.differences(x, x, ["k"]).count() == 0 and R.suspects(x, x.repartition(7), ["k"], ["s", "v"]).count() == 0
    one = a[:-1] + [(902, None, 5.0)]
    assert R.suspects(x, spark.createDataFrame(one, schema), ["k"], ["s", "v"]).count() == 1  # only one range is read row by row
    assert {tuple(r) for r in R.summary(R.differences(x, y, ["k"])).collect()} >= {("changed", "v", 1), ("left_only", None, 1)}
    with pytest.raises(ValueError, match="missing"):
        R.differences(x, y.drop("s"), ["k"])


# --- replies ----------------------------------------------------------------------------------------------

def test_reply_cache(spark, tmp_path):
    cache = A.Cache(spark, f"file://{tmp_path}/replies")
    asked = []

    def call(misses):
        asked.append(sorted((r.model, r.prompt) for r in misses.collect()))
        return misses.where("prompt <> 'fails'").select("key", F.concat("prompt", F.lit("!")).alias("reply"), F.lit(1_000_000).alias("input_tokens"), F.lit(10).alias("output_tokens"))

    rows = [(1, "m", "p"), (2, "m", "p"), (3, "n", "p"), (4, "m", None), (5, "m", ""), (6, "m", "fails")]
    df = spark.createDataFrame(rows, "request_id int, model string, prompt string")
    told = lambda name, x: {r.request_id: (r.reply, r.cached, r.cost_usd) for r in cache.answer(name, x, call, 2.0, 0.0).collect()}
    first = told("one", df)
    assert first == {1: ("p!", False, 2.0), 2: ("p!", True, 0.0), 3: ("p!", False, 2.0), 4: ("!", False, 2.0), 5: ("!", True, 0.0), 6: (None, False, None)}
    assert told("one", df) == first and len(asked) == 1  # repeated, not asked again
    assert told("two", df.union(spark.createDataFrame([(7, "m", "q")], df.schema)))[7] == ("q!", False, 2.0)
    assert asked == [[("m", ""), ("m", "fails"), ("m", "p"), ("n", "p")], [("m", "fails"), ("m", "q")]]
    assert cache.replies().count() == 4 and not cache.merge("two", cache.replies())
    import hashlib

    assert {r.key for r in cache.replies().collect()} >= {hashlib.sha256(b"m\x00p").hexdigest(), hashlib.sha256(b"m\x00").hexdigest()}
    r = A.estimated(spark.createDataFrame([(1, "m", "p"), (2, "m", "x" * 9), (3, "m", "x" * 9)], df.schema), cache, 4.0, 100, 1.0, 5.0).first()
    assert (r.prompts, r.calls, r.input_tokens, r.output_tokens) == (2, 1, 3, 100) and r.cost_usd == pytest.approx(0.000503)


# --- layers -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["market_industries_bucketed", "market_skill_categories_bucketed"])
def test_bucketed_layers_join_without_exchange(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = T.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.splitlines()
    at = [i for i, x in enumerate(lines) if "SortMergeJoin [job_id" in x or "ShuffledHashJoin [job_id" in x]
    assert at
    for i in at:
        depth = re.search(r"\w|\*", lines[i].replace(":", " ").replace("|", " ")).start()
        below = list(itertools.takewhile(lambda x: re.search(r"[\w*]", x.replace(":", " ")).start() > depth, lines[i + 1 :]))
        assert not [x for x in below if "Exchange" in x] and [x for x in below if "Bucketed: true" in x]


def test_layers_are_laid_out_and_dropped(spark):
    made = layers.write(spark.range(1000).select((F.col("id") % 10).alias("k"), "id"), "t", "k", 4, "layer_of_test")
    assert made.count() == 1000 and made.groupBy("k").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    layers.drop(spark, "layer_of_test")
    assert not spark.catalog.databaseExists("layer_of_test")


# --- resampling -----------------------------------------------------------------------------------------------

def test_weights_are_reproducible_counts(spark):
    df = spark.range(3000).withColumnRenamed("id", "job_id")
    w = np.array([r.w for r in df.orderBy("job_id").select(B.weights(draws=50).alias("w")).collect()])
    again = np.array([r.w for r in df.repartition(7).orderBy("job_id").select(B.weights(draws=50).alias("w")).collect()])
    assert w.shape == (3000, 50) and (w == again).all()
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
    assert (np.array([r.w for r in df.orderBy("job_id").select(B.weights(draws=50, seed=1).alias("w")).collect()]) != w).any()


def test_bootstrap_covers_the_difference(spark):
    rows = [(i, m, int(i % k != 0) if (i, m) != (5, "click") else None) for i in range(600) for m, k in (("rules", 2), ("click", 5))]
    items = spark.createDataFrame(rows, "job_id int, method string, hit int")
    got = B.bootstrap(B.cells(items, {"hit": B.mean("hit")}), "rules", 400).collect()
    assert len(got) == 1 and got[0].n == 599 and got[0].difference == pytest.approx(0.3, abs=0.004)
    spread = math.sqrt(0.3 * (1 - 0.3) / 599)  # differences here are 0 or 1 and -1 or 0
    assert got[0].ci_low < got[0].difference < got[0].ci_high and 2 * spread < got[0].ci_high - got[0].ci_low < 8 * spread and got[0].excludes_zero
    assert B.bootstrap(B.cells(items.where("false"), {"hit": B.mean("hit")}), "rules").collect() == []
    # the same by numpy with the same weights
    w = {r.job_id: np.array(r.w) for r in items.select("job_id").distinct().select("job_id", B.weights(draws=400).alias("w")).collect()}
    a, b = ({i: h for i, m, h in rows if m == name} for name in ("click", "rules"))
    paired = [i for i in a if a[i] is not None]
    total = sum(w[i] for i in paired)
    drawn = sum(w[i] * (a[i] - b[i]) for i in paired) / total
    assert [got[0].ci_low, got[0].ci_high] == pytest.approx(list(np.quantile(drawn, [0.025, 0.975])))


def test_exact_test_in_closed_form(spark):
    cases = [(a, b) for a in range(0, 40, 3) for b in range(0, 60, 7)] + [(400, 600), (1000, 1100), (0, 900), (3, 900)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a bigint, b bigint").select("i", B.binomial_two_sided(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        a, b = cases[r.i]
        want = min(Fraction(1), 2 * sum(Fraction(math.comb(a + b, i), 2 ** (a + b)) for i in range(min(a, b) + 1)))
        assert r.p == pytest.approx(float(want), rel=1e-9, abs=1e-300), (a, b)


def test_exact_test_of_huge_counts(spark):
    n = 10**9
    cases = [(n, n + 200_000), (n, n + 10), (n // 2, n), (n, n)]
    got = [r.p for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a bigint, b bigint").select("i", B.binomial_two_sided(F.col("a"), F.col("b")).alias("p")).orderBy("i").select("p").collect()]

    def normal(a, b):  # with a correction for continuity; good where counts are huge
        return math.erfc((abs(a - b) - 1) / math.sqrt(2 * (a + b)))

    assert got[0] == pytest.approx(normal(*cases[0]), rel=1e-6) and got[1] == pytest.approx(normal(*cases[1]), rel=1e-9) and got[2] < 1e-300 and got[3] == 1.0


# --- columns -----------------------------------------------------------------------------------------------------

GOLD = [(1, ["SQL", "Python"], ["AWS"], "Remote", 3.0), (2, ["Excel"], [], "Hybrid", None)]
FOUND = [(1, ["sql", "Tableau"], ["aws"], "remote", 4.0), (2, [], ["Excel"], "Onsite", 5.0)]
FIELDS = "job_id bigint, required_skills array<string>, preferred_skills array<string>, work_arrangement string, years_experience_min double"


def test_columns_under_other_names(spark):
    gold = spark.createDataFrame(GOLD, FIELDS).toDF("id", "gold_required_skills", "skills_preferred", "work_type", "years")
    found = spark.createDataFrame(FOUND, FIELDS).toDF("posting_id", "required", "nice_to_have_skills", "whereabouts", "years_min").withColumn("extractor", F.lit("m"))
    a, b = L.standardised(gold, "gold"), L.standardised(found, overrides=L.overrides_of('{"work_arrangement": "whereabouts"}'))
    assert a.columns == b.columns and [r.method for r in a.collect()] == ["gold"] * 2
    r = C.method_summary(C.score_items(C.standardised(a, False), C.standardised(b, True))).first()
    assert (r.required_precision, r.required_recall) == (0.5, 0.3333) and r.work_accuracy == 0.5 and r.years_within_1 == 0.5
    none = L.standardised(spark.createDataFrame(GOLD, FIELDS).drop("work_arrangement"), "m", needs_arrangement=False)
    assert [r.work_arrangement for r in none.collect()] == [None, None]


def test_columns_that_cannot_be_resolved():
    cols = ["id", "required", "preferred", "work_type", "years", "method"]
    assert L.resolve(cols, list(L.ALIASES))["variant"] == "method"
    for bad, overrides, message in ((cols[1:], {}, "no column for 'job_id'"), ([*cols, "id"], {}, "occurs 2 times"), (cols, {"job_id": "none"}, "is no column"), (cols, {"preferred_skills": "required"}, "several columns"), (cols, {"what": "id"}, "unknown columns")):
        with pytest.raises(L.Unresolved, match=message):
            L.resolve(bad, list(L.ALIASES), overrides=overrides)
    with pytest.raises(ValueError, match="JSON object"):
        L.overrides_of("[1]")


# --- files ---------------------------------------------------------------------------------------------------------

def test_swap_never_loses_the_target(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    files.write_guarded(spark.range(5), target)
    (tmp_path / "t").rename(tmp_path / "t.old")  # a run died between its two renames
    with pytest.raises(ValueError, match="shrink from 5"):
        files.write_guarded(spark.range(3), target)
    assert spark.read.parquet(target).count() == 5
    assert files.write_guarded(spark.range(6), target) == 6 and spark.read.parquet(target).count() == 6


def test_export_of_allowed_columns(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, 0.5, None, "p"), (2, float("nan"), "x", "p"), (3, float("inf"), None, "p")], "id int, v double, s string, new_private string")
    assert files.export(df, f"file://{tmp_path}/e", ["id", "v", "s"], keys=["id"]) == 3
    got = [json.loads(x) for f in (tmp_path / "e").glob("part*") for x in f.read_text().splitlines()]
    assert sorted(got, key=lambda r: r["id"]) == [{"id": 1, "v": 0.5, "s": None}, {"id": 2, "v": None, "s": "x"}, {"id": 3, "v": None, "s": None}]
    with pytest.raises(ValueError, match="missing"):
        files.export(df, f"file://{tmp_path}/e", ["id", "w"])
    with pytest.raises(ValueError, match="rules are broken"):
        files.export(df.union(df), f"file://{tmp_path}/e", ["id"], keys=["id"])
    assert files.export(df, f"file://{tmp_path}/top", ["id"], top=("id", 2)) == 2
