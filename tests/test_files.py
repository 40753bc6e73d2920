"""Readers, sinks with guards, quality rules and exact tests on small tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quarryline.operators import datasets as D
from quarryline.operators import quality as Q
from quarryline.operators import resampling
from quarryline.sources import files, seeds


def test_csv_with_quoted_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text('job_id,text\n1,"two\nlines, and ""quotes"""\n2,\n')
    got = files.read_any(spark, f"file://{tmp_path}/p.csv").orderBy("job_id").collect()
    assert [(r.job_id, r.text) for r in got] == [(1, 'two\nlines, and "quotes"'), (2, None)]


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "b.json").write_text(json.dumps({"n": 1, "labels": [{"x": 1}, {"x": 2}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "m.json").write_text(json.dumps({"benchmark": [5, 7]}))
    for name in ("a.jsonl", "b.json", "c.json"):
        assert sorted(r.x for r in files.read_any(spark, f"file://{tmp_path}/{name}").collect()) == [1, 2]
    assert [r.job_id for r in files.manifest_ids(spark, f"file://{tmp_path}/m.json", "benchmark").collect()] == [5, 7]
    with pytest.raises(ValueError):
        files.read_any(spark, "x.xyz")
    registry = files.Registry(spark, f"file://{tmp_path}", {"rows": "a.jsonl"})
    assert registry.views() == ["rows"] and spark.sql("select sum(x) from rows").first()[0] == 3
    with pytest.raises(KeyError):
        registry.read("none")


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_guarded_sink(spark, tmp_path, kind):
    target = f"file://{tmp_path}/t"
    rows = lambda *ids: spark.createDataFrame([(i, "a\nb") for i in ids], "job_id bigint, t string")
    assert files.write_guarded(rows(1, 2, 3), target, ["job_id"], kind=kind) == 3
    with pytest.raises(ValueError, match="shrink"):
        files.write_guarded(rows(1), target, kind=kind)
    for bad in (rows(1, 2, 2, 3), rows(1, 2, None, 3)):
        with pytest.raises(ValueError, match="rules are broken"):
            files.write_guarded(bad, target, ["job_id"], kind=kind)
    assert files.write_guarded(rows(1, 2, 3, 4), target, ["job_id"], kind=kind) == 4
    assert files.write_guarded(rows(9), target, may_shrink=True, kind=kind) == 1


def test_export_and_layers(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "secret"), (2, 7, "secret"), (3, 7, "secret")], "id int, n int, description string")
    files.export(df, f"file://{tmp_path}/e", ["id", "n"], top=("n", 2), keys=["id"])
    got = spark.read.json(f"file://{tmp_path}/e")
    assert got.columns == ["id", "n"] and sorted(r.id for r in got.collect()) == [2, 3]
    made = files.layered({"one": df, "two": df.where("id > 1")}, f"file://{tmp_path}/layers")
    assert made["two"].count() == 2


def test_not_in_follows_sql(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    found = lambda *taken: sorted((r.k for r in D.not_in(left, spark.createDataFrame([(t,) for t in taken], "k int"), "k").collect()), key=repr)
    assert found(1) == [2] and found(1, None) == [] and found() == [1, 2, None]


def test_exact_test_of_large_counts(spark):
    cases = [(0, 0), (5, 0), (3, 9), (400, 600), (1000, 1100), (50_000, 50_400)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a bigint, b bigint").select("i", resampling.binomial_two_sided(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        a, b = cases[r.i]
        n, k = a + b, min(a, b)
        want = min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))
        assert r.p == pytest.approx(want, rel=1e-6, abs=1e-12)


def test_numeric_equal_and_seed(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-12), (1.0, 1.1), (None, None), (float("nan"), float("nan")), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(Q.numeric_equal(F.col("a"), F.col("b"))).collect()] == [True, False, True, True, False]
    assert seeds.skill_patterns(spark).count() == 39
