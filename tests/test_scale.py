"""What larger tables need: joins that keep made-up columns away from the driver, and work dealt out by rows."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quarryline import sources as S
from quarryline.operators import normalise as N
from quarryline.operators import quality as Q
from quarryline.operators import resampling as R
from quarryline.operators import scoring as C
from quarryline.plans import QUERIES

DATA = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["item_scores", "method_summary", "method_metrics_long", "metric_winners", "pairwise_tests", "top_missed_skills", "top_extra_skills"])
def test_items_are_joined_without_a_broadcast(spark, name):
    """Sizes of made-up columns are guessed too low, so Spark would send all predictions through the driver."""
    assert "BroadcastHashJoin [job_id" not in planned(QUERIES[name](spark, DATA))


def test_predictions_lie_by_posting(spark):
    """Both sides are dealt out by key alone, before their lists are made; the join and what counts by posting need no other exchange."""
    plan = QUERIES["item_scores"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert moved == ["o_orderkey", "o_orderkey"] and "BroadcastExchange" not in plan


def test_one_row_group_is_many_tasks(spark, tmp_path):
    """A file of one row group and more splits than cores was one task's work."""
    spark.range(0, 2_000_000, 1, 1).select("id", F.md5(F.col("id").cast("string")).alias("t")).write.option("parquet.block.size", 1 << 30).parquet(f"file://{tmp_path}/t.parquet")
    dealt = S.spread(S.table(spark, f"file://{tmp_path}", "t"), "id")
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 60 and max(r["count"] for r in sizes) < 2_000_000 / 30


def test_draws_are_those_of_the_weights(spark):
    """Sums by batches equal those of the weights as columns, for draws that aren't a multiple of a digest's numbers."""
    rows = spark.range(300).select(F.col("id").alias("job_id"), F.lit("f").alias("metric"), F.lit("m").alias("method"), (F.col("id") % 3).cast("double").alias("num"), F.lit(2.0).alias("den"), (F.col("id") % 5).cast("double").alias("bnum"), F.lit(4.0).alias("bden"))
    columns = ("num", "den", "bnum", "bden")
    want = rows.select(*columns, F.posexplode(R.weights("job_id", 10, 7)).alias("draw", "w")).where("w > 0").groupBy("draw").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in columns))
    got = rows.select(F.col("job_id").cast("string"), "metric", "method", *columns).mapInArrow(R._weighted(10, 7), R._DRAWN).groupBy("draw").agg(*(F.sum(c).alias(c) for c in columns))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    few = rows.where("job_id = 3").select(F.col("job_id").cast("string"), "metric", "method", *columns).mapInArrow(R._weighted(10, 7), R._DRAWN)
    zero = [i for i, w in enumerate(rows.where("job_id = 3").select(R.weights("job_id", 10, 7).alias("w")).first().w) if not w]
    assert zero and not set(zero) & {r.draw for r in few.collect()}


def test_patterns_meet_texts_without_a_broadcast(spark):
    plan = planned(QUERIES["pattern_mentions"](spark, DATA))
    assert "BroadcastHashJoin [job_id" not in plan and "BroadcastHashJoin [_word" not in plan and "BroadcastHashJoin [_gram" not in plan


def test_quality_rules_join_without_a_broadcast(spark):
    a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(50, 200).withColumnRenamed("id", "k")
    pairs = b.select("k", F.lit("m").alias("method"))
    for df, want in ((Q.all_present("x", a, b, "k"), 50), (Q.no_overlap("x", a, b, "k"), 50), (Q.missing_pairs("x", a, pairs, ["m"], "k"), 50)):
        assert "BroadcastHashJoin" not in planned(df) and df.first().failures == want
    assert "BroadcastHashJoin" not in planned(QUERIES["mart_quality"](spark, DATA))


def test_bootstrap_reads_items_once(spark):
    """Draws and whole sums come from the same pairs, which meet by posting without another exchange or sort."""
    items = QUERIES["item_scores"](spark, DATA)
    plan = R.bootstrap(R.cells(items, {s: R.micro_f1(s) for s in ("required", "any_skill")}), "rules", 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("SortMergeJoin") == 1
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan).count("o_orderkey") == 2 and "hashpartitioning(job_id" not in plan
    exact = C.paired(items, ["work_correct", "years_exact"], "rules")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(job_id" not in exact and "Sort [job_id" in exact and not re.search(r"Sort \[job_id[^\]]*, metric", exact)


def test_pairs_need_one_baseline(spark):
    """Items with two baselines, none, an unknown score or no key are in no pair; metrics are paired each for itself."""
    rows = [(1, "rules", 1, 1), (1, "a", 0, 1), (2, "rules", 1, None), (2, "a", 1, 1), (3, "rules", 1, 1), (3, "rules", 0, 0), (3, "a", 1, 1), (4, "a", 1, 1), (None, "rules", 1, 1), (None, "a", 0, 0), (5, "rules", 0, 0), (5, "a", 1, None), (5, "b", 0, 1)]
    items = spark.createDataFrame(rows, "job_id int, method string, x int, y int").repartition(3)
    got = {(r.metric, r.method): (r.n, r.difference) for r in R.bootstrap(R.cells(items, {m: R.mean(m) for m in ("x", "y")}), "rules", 40).collect()}
    assert got == {("x", "a"): (3, pytest.approx(0.0)), ("x", "b"): (1, 0.0), ("y", "a"): (1, 0.0), ("y", "b"): (1, 1.0)}


def test_plain_lists_are_only_split(spark):
    """The shorter way gives what the longer one gives, for plain and odd lists."""
    texts = ["sql, python", "sql,sql", "b, a,c", "a,  b", "a ,b", "a,", ",a", "", " ", "none", "None", "none, sql", "null", "[]", "[sql]", '["SQL", "b"]', "power bi, sql", "powerbi, sql", "k8s", "mypostgres", "mssql,postgres", "python 3, excel", "R", "ml;sql|x", "a\nb", "a\n", "é, a", None, ",".join(f"w{i}" for i in range(20000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", N.listed_skills(F.col("t")).alias("a"), N.skill_set(N.parse_list(F.col("t"))).alias("b")).collect():
        assert r.a == r.b, r.t
    assert [r.v for r in spark.createDataFrame([("Remote",), ("remote",), ("Unclear",), (None,)], "t string").select(N.work(F.col("t")).alias("v")).collect()] == ["Remote", "Remote", "Unclear", "Unclear"]
    # columns of predictions that nobody asks for aren't made
    assert "tableau" in planned(S.found(spark, DATA)) and "tableau" not in planned(S.found(spark, DATA).select("job_id", "method", "years_experience_min"))


def test_digests_are_the_interpreters_own():
    """Weights are drawn with the interpreter's own digest, where there is one; it is the usual one."""
    own = pytest.importorskip("_md5")
    assert R.md5 is own.md5
    assert all(R.md5(x, usedforsecurity=False).digest() == hashlib.md5(x, usedforsecurity=False).digest() for x in (b"", b"42:1:0", "42:é".encode() * 40))


def test_items_are_scored_as_by_sets(spark):
    """Counts from arrays that may be null, empty, out of order, and have nulls and repeated names; sets are put in order before they meet."""
    lists = [None, [], ["a"], ["a", "a"], ["b", "a"], ["a", "b", "c"], [None, "a"], ["c", None, None]]
    pairs = [(a, b) for a in lists for b in lists]
    kinds = "required array<string>, preferred array<string>, work string, years double"
    gold = spark.createDataFrame([(i, a, b, "Remote", 1.0) for i, (a, b) in enumerate([*pairs, (["a"], ["b"])])], f"job_id int, {kinds}")
    found = spark.createDataFrame([(i, f"m{m}", a, b, "Hybrid", None) for i in range(len(pairs)) for m, (a, b) in enumerate(pairs)], f"job_id int, method string, {kinds}")
    nothing = F.array().cast("array<string>")
    p = found.select("job_id", "method", *(F.coalesce(c, nothing).alias(f"p_{c}") for c in ("required", "preferred")))
    both = gold.join(p, "job_id", "left").withColumns({f"p_{c}": F.coalesce(f"p_{c}", nothing) for c in ("required", "preferred")}).withColumns({f"{x}any_skill": F.array_union(f"{x}required", f"{x}preferred") for x in ("", "p_")})
    cols = []
    for s in C.SCOPES:
        tp = F.size(F.array_intersect(s, f"p_{s}"))
        cols += [tp.alias(f"{s}_tp"), (F.size(F.array_distinct(f"p_{s}")) - tp).alias(f"{s}_fp"), (F.size(F.array_distinct(s)) - tp).alias(f"{s}_fn"), (F.sort_array(s) == F.sort_array(f"p_{s}")).alias(f"{s}_exact")]
    swapped = lambda x: F.array_except(f"{x}preferred", f"{x}required")
    right = F.size(F.array_union(F.array_intersect("required", "p_required"), F.array_intersect(swapped(""), swapped("p_"))))
    want = both.select("job_id", "method", *cols, F.size(F.array_intersect("any_skill", "p_any_skill")).alias("skill_type_overlap"), right.alias("skill_type_correct"))
    got = C.score_items(gold, found)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == len(pairs) ** 2 + 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "sort_array" not in plan[: plan.index("Join LeftOuter")]
    # the counts of one scope don't ask for the other's sets
    one = C.score_items(C.standardised(S.gold(spark, DATA), False), C.standardised(S.found(spark, DATA), True)).select("method", "required_tp", "required_fp", "required_fn")
    assert "spark, kafka" not in planned(one) and "aws, sql" not in planned(one) and "tableau, sql, dbt" in planned(one)


def test_a_single_name_is_its_list(spark):
    cases = ["sql", "mssql", "k8s", "r", "R", "nan", "none", "", "a,", ",a", "a, a", "b,a", "a b", " a", "[]", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = df.select("i", N.listed_skills(F.col("c")).alias("v"), N.skill_set(N.parse_list(F.col("c"))).alias("w")).collect()
    assert all(r.v == r.w for r in got) and got[0].v == ["sql"]
    assert "ELSE array(c#" in df.select(N.listed_skills(F.col("c")))._jdf.queryExecution().analyzed().toString()
