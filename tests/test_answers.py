"""Errors, ties, costs, samples and records on small tables."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import datasets as D
from quarryline.operators import extract as E
from quarryline.operators import market as M
from quarryline.operators import scoring as C
from quarryline.sources import files


def test_ties_name_all_methods(spark):
    long = spark.createDataFrame([("a", "f1", 0.5), ("b", "f1", 0.5), ("c", "f1", 0.4), ("a", "years_mae_answered", 2.0), ("b", "years_mae_answered", 1.0), ("c", "years_mae_answered", None), ("a", "none", None)], "method string, metric string, value double")
    assert {tuple(r) for r in C.tied_winners(long).collect()} == {("f1", 0.5, "a,b", 2), ("years_mae_answered", 1.0, "b", 1)}


def test_methods_in_their_usual_order(spark):
    rows = spark.createDataFrame([(m,) for m in ("zeta", "decomposed", "alpha", "few_shot", "rules")], "method string")
    assert [r.method for r in C.in_method_order(rows).orderBy("place").collect()] == ["rules", "few_shot", "decomposed", "alpha", "zeta"]


def test_errors_are_counted(spark):
    flags = list(C.ERRORS.values())
    items = spark.createDataFrame([("m", *[True] * 5), ("m", False, None, False, True, False)], ", ".join(["method string", *(f"{f} boolean" for f in flags)]))
    r = C.error_counts(items).first()
    assert (r.postings, r.required_errors, r.preferred_errors, r.work_errors, r.years_error_rate, r.place) == (2, 1, 0, 0, 0.5, 1)


def test_quotes_without_a_value(spark):
    rows = [("m", None, "pay $5"), ("m", 5.0, "pay $5"), ("m", None, " \t "), ("m", None, None), ("n", None, None)]
    got = {r.method: tuple(r)[1:] for r in C.evidence_consistency(spark.createDataFrame(rows, "method string, salary_min double, evidence_salary string")).collect()}
    assert got == {"m": (2, 1, 50.0), "n": (0, 0, 0.0)}


def test_diagnostic_rows(spark):
    rows = [(1, "plain", "hybrid"), (2, "this is Hybrid work", "Hybrid"), (3, "nothing", "unclear"), (4, "remote or on-site", "unclear"), (5, "hybrid", "remote")]
    chosen = lambda rs: sorted(r.job_id for r in D.diagnostic_rows(spark.createDataFrame([(i, t) for i, t, _ in rs], "job_id int, description string"), spark.createDataFrame([(i, g) for i, _, g in rs], "job_id int, work_arrangement string")).collect())
    assert chosen(rows) == [2, 4] and chosen(rows[:1] + rows[2:]) == [1, 4] and chosen([rows[0], rows[2]]) == [1, 3] and chosen([rows[1], rows[2]]) == [2, 3]
    with pytest.raises(Exception, match="no two diagnostic"):
        chosen([rows[1], rows[4]])


def test_prompts_and_their_costs(spark):
    postings = spark.createDataFrame([(1, "T{title}", "D" * 10), (2, None, None)], "job_id int, title string, description string")
    got = {(r.job_id, r.variant): r.prompt for r in D.prompts(postings, {"a": "<{title}|{description}>", "b": "{title}{description}"}).collect()}
    assert got == {(1, "a"): "<T{title}|DDDDDDDDDD>", (2, "a"): "<|>", (1, "b"): "T{title}DDDDDDDDDD", (2, "b"): ""}
    with pytest.raises(ValueError, match="unknown variants"):
        D.prompts(postings, {"a": "{title}{description}"}, ["z"])
    costs = {r.variant: tuple(r)[1:4] for r in D.dry_run(D.prompts(postings, {"a": "<{title}|{description}>"}), 1.0, 5.0).collect()}
    assert costs == {"a": (2, 6.0, 500), None: (2, 6.0, 500)}


def test_records_have_one_map_of_evidence(spark):
    text = "Pay is $50K per year. This role is remote. SQL is required. At least 3 years of experience."
    r = E.records(spark.createDataFrame([(1, "Senior Data Analyst", text), (2, None, None)], "job_id int, title string, text string")).orderBy("job_id").collect()
    assert (r[0].salary_min, r[0].pay_period, r[0].seniority, r[0].years_experience_min, r[0].work_arrangement, r[0].required_skills) == (50000.0, "YEARLY", "Mid-Senior level", 3, "remote", ["SQL"])
    assert sorted(r[0].evidence) == ["salary", "seniority", "skill:SQL", "work_arrangement", "years_experience"] and r[0].evidence["salary"] == "$50K"
    assert r[1].evidence == {} and r[1].work_arrangement == "unclear" and r[1].n_required == 0


def test_skills_in_display_order(spark):
    rows = [("b", 2, "A family", 5), ("a", 1, "A family", 5), ("c", 3, "All data roles", 1), ("d", 4, "A family", 9)]
    got = M.ranked_skills(spark.createDataFrame(rows, "skill_name string, display_order int, role_family string, postings int"))
    assert [r.skill_name for r in got.orderBy("place").collect()] == ["c", "d", "a", "b"]


def test_ids_as_whole_numbers(spark):
    texts = ["12", " 12 ", "2774458.0", "1.5", "-1.5", "1e3", "none", "", None, "99999999999999999999"]
    got = [r.v for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", M.whole_id("t").alias("v")).orderBy("i").collect()]
    assert got == [12, 12, 2774458, 2, -2, 1000, None, None, None, None]


def test_registry_checks_its_rules(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, -1), (2, 3)], "k int, v int").write.parquet(f"file://{tmp_path}/t.parquet")
    made = files.Registry(spark, f"file://{tmp_path}", {"t": "t.parquet"}, {"t": ["k"]}, {"t": {"positive": F.col("v") > 0}})
    assert {tuple(r) for r in made.report("t").collect()} == {("has_k", 0), ("positive", 1), ("unique_k", 1)}
    with pytest.raises(ValueError, match="rules are broken"):
        made.checked("t")
    assert files.Registry(spark, f"file://{tmp_path}", {"t": "t.parquet"}).checked("t").count() == 3
    with pytest.raises(KeyError, match="unknown sources"):
        files.Registry(spark, f"file://{tmp_path}", {"t": "t.parquet"}, {"x": ["k"]})


def test_items_keep_postings_without_a_prediction(spark):
    kinds = "job_id int, required array<string>, preferred array<string>, work string, years double"
    gold = spark.createDataFrame([(1, ["sql"], [], "Remote", 3.0), (2, ["sql"], ["r"], "Remote", None)], kinds)
    found = spark.createDataFrame([(1, ["sql"], None, "Remote", 3.0, "m"), (9, ["x"], [], "Remote", 1.0, "m")], f"{kinds}, method string")
    got = {r.job_id: r for r in C.score_items(gold, found).collect()}
    assert set(got) == {1, 2} and got[1].required_tp == 1 and got[1].preferred_exact
    assert (got[2].method, got[2].required_fn, got[2].any_skill_fn, got[2].years_pred_answered) == (None, 1, 2, False)
    with pytest.raises(Exception, match="no match on the right for job_id=2"):
        C.score_items(gold, found, "fail").collect()
    with pytest.raises(Exception, match="several rows of job_id=1"):
        C.score_items(gold.union(gold), found).collect()
