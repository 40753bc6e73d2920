"""Strings looked for all at once, and counts that sums and quantiles share."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.functions import beside, cells_of, quantiles_of, valued, with_quantiles
from quarryline.operators import datasets as D
from quarryline.operators import market as M
from quarryline.operators import patterns as P
from quarryline.plans import QUERIES
from quarryline.sources.seeds import SKILL_PATTERNS

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "s", "sq", "sql", "xsql", "sqlx", "sq", "l", "l sq", "no sql, mysql-git/github", "ésqlé", "KKel", "python / r", "r/python", "google cloud", "sql\nsql", "_sql", "sql_", "aws" * 40, "power  bi", "git git1 git", "日本 sql", "xaws aws, aws"]


@pytest.fixture
def plain(spark):
    """Plans as they are before they run, with what is reused marked."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_strings_that_occur_are_those_found_one_by_one(spark):
    """More strings than a number has bits, strings that begin alike, ends of texts in the middle of a string."""
    strings = sorted({"sql", "mysql", "git", "github", "aws", "google", "google cloud", "r/", "és", "ll", "l sq"} | {f"w{i}" for i in range(80)})
    texts = ODD + [f"w{i} w{i + 1}" for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    held = df.select("t", P.occurring(strings)(F.col("t")).alias("h"))
    got = held.select("t", *(P.holds(F.col("h"), strings, [s]).alias(f"c{i}") for i, s in enumerate(strings))).collect()
    assert len(got) == len(texts)
    for row in got:
        assert list(row[1:]) == [None if row.t is None else s in row.t for s in strings], row.t


def test_strings_in_parts_of_arrays_and_over_blocks(monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    held = P.occurring(["abc", "bc"]).func
    texts = pa.array(["zz", "abc", None, "ab", "c", "x" * 50 + "bc", "", "abcabc"])
    for part in (texts, texts.slice(1, 5), texts.slice(7), texts.slice(0, 0)):
        assert held(part).to_pylist() == [None if t is None else [("abc" in t) | ("bc" in t) << 1] for t in part.to_pylist()]


def test_a_pattern_that_begins_with_its_word_finds_the_same(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for word in ("sql", "git", "aws"):
        rows = df.select(F.col("t").rlike(rf"\b{word}\b").alias("a"), F.col("t").rlike(P.begun(rf"\b{word}\b")).alias("b")).collect()
        assert all(r.a == r.b for r in rows) and any(r.a for r in rows)
    assert P.begun("a|b") == "a|b"


def test_mentions_are_those_of_the_patterns(spark):
    kept = dict.fromkeys(["role_family", "company_name", "location", "experience_level", "remote_status"], "x")
    roles = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "job_id int, description string").withColumns({k: F.lit(v) for k, v in kept.items()} | {c: F.lit(1) for c in ("posting_date", "company_id", "annualized_salary_usd", "has_valid_salary")})
    got = {(r.job_id, r.skill_name) for r in M.skill_mentions(roles).collect()}
    assert got == {(i, n) for i, t in enumerate(ODD) if t for n, _, p, _ in SKILL_PATTERNS if re.search(p, t.lower())}


@pytest.mark.parametrize("name", ["role_skills", "role_skills_ranked"])
def test_mentions_are_looked_for_once(spark, plain, name):
    """They were found once for the counts and twice for the medians."""
    assert plain(QUERIES[name](spark, DATA)).count("Generate inline(") == 1


def test_family_days_are_counted_once(spark, plain):
    assert plain(QUERIES["role_daily"](spark, DATA)).count("FileScan") == 1


@pytest.mark.parametrize("name", ["metric_ties", "method_summary", "metric_winners"])
def test_items_are_scored_once(spark, plain, name):
    """They were joined once for the sums and once for the macro F1."""
    assert plain(QUERIES[name](spark, DATA)).count("SortMergeJoin [job_id") == 1


def test_quantiles_count_values_once(spark, plain):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") % 91).cast("double").alias("v"), "id").repartition(3, "id")
    assert plain(with_quantiles(df.groupBy("k").agg(F.count("*").alias("n")), df, ["k"], "v", {"m": 0.5})).count("Range (0") <= 2


def test_quantiles_of_cells_are_those_of_rows(spark):
    df = spark.range(2000).select((F.col("id") % 5).alias("k"), (F.col("id") % 3).alias("also"), F.when(F.col("id") % 4 > 0, (F.col("id") * 37 % 101).cast("double")).alias("v")).where("k > 0 or v is null")
    sums = df.groupBy("k").agg(F.count("*").alias("n"))
    got = beside(sums, quantiles_of(valued(cells_of(df, ["k", "also"], "v")), ["k"], {"m": 0.5, "q": 0.9}, None), ["k"])
    want = sums.join(df.groupBy("k").agg(F.expr("percentile(v, 0.5)").alias("m"), F.expr("percentile(v, 0.9)").alias("q")), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("k = 0").first().m is None


def test_signals_of_odd_texts(spark):
    """A capital letter that becomes two when lowered is no mention of a year; a null text has no signals."""
    df = spark.createDataFrame([(1, "İİ sql _sql, our stack; must have, a plus. 3 years on-site $5 $ 7"), (2, "plain"), (3, None)], "job_id int, description string")
    a, b, c = D.difficulty(df).orderBy("job_id").collect()
    assert (a.n_skills, a.has_both_hedges, a.year_mention_density, a.n_arrangement_words, a.n_dollar_figures, a.has_company_stack_language) == (1, 1, 3, 1, 2.5, 1)
    assert (b.n_skills, b.year_mention_density, b.difficulty) == (0, 0, 0.0)
    assert D.difficulty(df.where("job_id = 1").withColumn("description", F.lit("İİ İ"))).first().year_mention_density == 0 and c.n_skills is None
