"""Scores and statistics of extraction methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import annualized, f1_or, ratio, rounded, with_quantiles
from . import contracts as J
from . import normalise as N
from . import resampling as R
from .resampling import binomial_two_sided

# Dollars per million tokens in and out, and per call; the levels that are scored.
COST_IN, COST_OUT, COST_PER_CALL = 1.0, 5.0, 2.39 / 1000
METHOD_ORDER = ["rules", "zero_shot", "few_shot", "schema_rules", "decomposed"]
LEVELS = ["Internship", "Entry level", "Associate", "Mid-Senior level", "Director", "Executive"]


# --- salaries, periods and levels against the labels ------------------------------------------------

def ground_truth(labelled: DataFrame) -> DataFrame:
    """The provider's own fields as truth, with the shape of the salary label."""
    low, high = F.coalesce("min_salary", "med_salary"), F.coalesce("max_salary", "med_salary")
    shape = F.when(F.col("min_salary").isNotNull(), "range").when(F.col("med_salary").isNotNull(), "point").otherwise("none")
    return labelled.select("job_id", "stratum", "role_family", F.col("pay_period").alias("gt_pay_period"), low.alias("gt_salary_min"), high.alias("gt_salary_max"), shape.alias("gt_label_shape"), F.col("exp_level").alias("gt_seniority"), annualized(low, F.col("pay_period")).alias("gt_salary_min_annual"), annualized(high, F.col("pay_period")).alias("gt_salary_max_annual"))


def staged_predictions(raw: DataFrame) -> DataFrame:
    cost = F.col("input_tokens") / 1e6 * COST_IN + F.col("output_tokens") / 1e6 * COST_OUT
    return raw.withColumns({"salary_min_annual": annualized(F.col("salary_min"), F.col("pay_period")), "salary_max_annual": annualized(F.col("salary_max"), F.col("pay_period")), "cost_usd": cost})


def scored_predictions(staged: DataFrame, truth: DataFrame) -> DataFrame:
    """Each prediction against the truth, on the postings that models saw; flags are null where they don't apply.
    Salaries count after annualising; silence is judged by the raw figure."""
    asked = staged.where("method <> 'rules'").select("job_id").distinct()
    both = staged.hint("merge").join(asked, "job_id", "left_semi").join(truth.hint("merge"), "job_id")
    stated, silent = F.col("stratum") == "labeled_stated", F.col("stratum") == "labeled_not_stated"
    gt, own = F.col("gt_salary_min_annual"), F.col("salary_min_annual")
    error = F.when(gt.isNotNull() & (gt != 0) & own.isNotNull(), F.abs(own - gt) / gt)
    within = F.when(~stated, None).when(own.isNull(), False).when(gt.isNull() | (gt == 0), None).otherwise(error <= 0.10)
    return both.select(
        "job_id", "method", "stratum", "gt_label_shape", "role_family", "gt_salary_min_annual", "salary_min", "salary_min_annual", "gt_pay_period", "pay_period", "gt_seniority", "seniority", "valid_json", "cost_usd",
        error.alias("salary_pct_error"), within.alias("salary_within_10pct"), F.when(silent, F.col("salary_min").isNull()).alias("abstained_correctly"), F.when(stated, F.col("pay_period").eqNullSafe(F.col("gt_pay_period"))).alias("pay_period_correct"),
        F.when(F.col("gt_seniority").isNotNull(), F.col("seniority").eqNullSafe(F.col("gt_seniority"))).alias("seniority_correct"), F.col("seniority").isNotNull().alias("seniority_answered"),
    )


def performance(scored: DataFrame) -> DataFrame:
    """One row a method; abstentions count as misses."""
    stated, silent, levelled = F.expr("stratum = 'labeled_stated'"), F.expr("stratum = 'labeled_not_stated'"), F.col("gt_seniority").isNotNull()
    rate = lambda flag, of: rounded(F.avg(F.when(of, F.coalesce(F.col(flag), F.lit(False)).cast("double"))), 4)
    n = F.count("*")
    sums = scored.groupBy("method").agg(
        n.alias("n_postings"), F.count_if(stated).alias("n_salary_eligible"), rate("salary_within_10pct", stated).alias("salary_within_10pct"), F.count_if(silent).alias("n_abstention_eligible"), rate("abstained_correctly", silent).alias("abstention_rate"), rate("pay_period_correct", stated).alias("pay_period_accuracy"),
        F.count_if(levelled).alias("n_seniority_labeled"), rate("seniority_correct", levelled).alias("seniority_accuracy"), rate("seniority_answered", levelled).alias("seniority_answer_rate"), rate("valid_json", F.lit(True)).alias("valid_json_rate"),
        rounded(F.sum("cost_usd"), 4).alias("total_cost_usd"), rounded(F.sum("cost_usd") / n * 1000, 2).alias("cost_per_1k_postings"),
    )
    return with_quantiles(sums, scored.where(stated), ["method"], "salary_pct_error", {"salary_median_error": 0.5}, 4)


def tolerance_bands(scored: DataFrame, bands: tuple = (0.05, 0.10, 0.20)) -> DataFrame:
    """Shares of salaries within each tolerance, of the attempted ones and end to end."""
    stated = scored.where("stratum = 'labeled_stated'")
    tried = F.col("salary_pct_error").isNotNull()
    rows = [F.struct(F.lit(b).alias("tolerance"), (tried & (F.col("salary_pct_error") <= b)).alias("hit")) for b in bands]
    return stated.select("method", tried.alias("tried"), F.inline(F.array(*rows))).groupBy("method", "tolerance").agg(F.count_if("tried").alias("attempted"), F.count("*").alias("eligible"), F.count_if("hit").alias("within")).withColumns({"of_attempted": rounded(ratio(F.col("within"), F.col("attempted")), 4), "end_to_end": rounded(ratio(F.col("within"), F.col("eligible")), 4)})


def contained(staged: DataFrame, truth: DataFrame, slack: float = 0.02) -> DataFrame:
    """Of point labels, how often the predicted range, widened by ``slack``, contains the label."""
    both = staged.join(truth.where("gt_label_shape = 'point'").hint("merge"), "job_id").where("salary_min is not null and salary_max is not null")
    inside = (F.col("gt_salary_min") >= F.col("salary_min") * (1 - slack)) & (F.col("gt_salary_min") <= F.col("salary_max") * (1 + slack))
    return both.groupBy("method").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside")).withColumn("share", rounded(ratio(F.col("inside"), F.col("n")), 4))


def operations(staged: DataFrame) -> DataFrame:
    """Calls, latency and cost by method; latency of calls that were made, not cached ones."""
    fresh = ~F.col("cached")
    sums = staged.where("method <> 'rules'").groupBy("method").agg(F.count("*").alias("predictions"), F.count_if(fresh).alias("api_calls"), rounded(F.avg(F.col("cached").cast("double")), 6).alias("cache_rate"), rounded(F.avg(F.when(fresh, F.col("latency_s"))), 3).alias("mean_latency_s"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if(~F.col("valid_json")).alias("invalid_json"), rounded(F.sum("cost_usd") / F.count("*") * 1000, 3).alias("cost_per_1k"))
    return with_quantiles(sums, staged.where("method <> 'rules' and not cached"), ["method"], "latency_s", {"median_latency_s": 0.5}, 3)


# --- agreement of labels ---------------------------------------------------------------------------

def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(truth, pred).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, truth: str, pred: str, values: list[str]) -> DataFrame:
    """The confusion counts with a column a predicted value."""
    return df.groupBy(truth).agg(*[F.count_if(F.col(pred) == v).alias(f"pred_{v}") for v in values], F.count_if(F.col(pred).isNull()).alias("pred_none"))


def per_class(df: DataFrame, keys: list[str], truth: str, pred: str, empty: float = 0.0, times: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support of each value that occurs as truth or prediction, by key; from the confusion
    counts, so each row is read once. A null prediction is a miss of the true class. ``times``: how often a row counts."""
    cells = df.groupBy(*keys, F.col(truth).alias("t"), F.col(pred).alias("p")).agg((F.sum(times) if times else F.count("*")).alias("n"))
    hit = F.col("t").eqNullSafe(F.col("p"))
    as_truth = F.struct(F.col("t").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn"))
    as_pred = F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("bigint").alias("fn"))
    both = cells.select(*keys, F.inline(F.array(as_truth, as_pred))).where("class is not null")
    s = both.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return s.select(*keys, "class", (tp + fn).alias("support"), rounded(ratio(tp, tp + fp), 4).alias("precision"), rounded(ratio(tp, tp + fn), 4).alias("recall"), f1_or(tp, fp, fn, empty).alias("f1"))


def macro_f1(df: DataFrame, keys: list[str], truth: str, pred: str, labels: list[str] | None = None, empty: float = 0.0, times: str | None = None) -> DataFrame:
    """The mean F1 over the given labels (those that occur nowhere count ``empty``), or over all that occur as truth."""
    classes = per_class(df, keys, truth, pred, empty, times)
    if labels is None:
        return classes.where("support > 0").groupBy(*keys).agg(rounded(F.avg("f1"), 4).alias("macro_f1"))
    own = classes.where(F.col("class").isin(labels)).groupBy(*keys).agg(F.sum("f1").alias("s"), F.count("*").alias("c"))
    return own.select(*keys, rounded((F.col("s") + (len(labels) - F.col("c")) * empty) / len(labels), 4).alias("macro_f1"))


# --- items: skills, arrangement, years -----------------------------------------------------------------

def standardised(df: DataFrame, prediction: bool) -> DataFrame:
    """Raw answers as canonical sets, arrangement and years, whether lists come as arrays or as texts and years as numbers or
    as texts. A prediction without an arrangement is invalid, not unclear."""
    kinds = dict(df.dtypes)
    sets = lambda c: N.skill_set(F.coalesce(c, F.array().cast("array<string>"))) if kinds[c].startswith("array") else N.listed_skills(F.col(c))
    number = N.years(F.col("years_experience_min")) if kinds["years_experience_min"] == "string" else F.col("years_experience_min").cast("double")
    work = N.work(F.col("work_arrangement"))
    if prediction:
        work = F.when(F.col("work_arrangement").isNull(), "InvalidPrediction").otherwise(work)
    return df.select("job_id", *(["method"] if prediction else []), sets("required_skills").alias("required"), sets("preferred_skills").alias("preferred"), work.alias("work"), number.alias("years"))


SCOPES = ("required", "preferred", "any_skill")


def score_items(gold: DataFrame, predictions: DataFrame, misses: str = "keep") -> DataFrame:
    """One row a posting and method: counts of skills found, missed and made up by scope, skills in the wrong bucket,
    arrangement, and years with abstentions. A posting is annotated once, else the job fails; one without any prediction
    stays as a row without a method, whose asked skills are all missed (``misses``: see ``contracts.join``)."""
    nothing = F.array().cast("array<string>")
    size = lambda c: F.size(c).cast("bigint")

    def counted(df: DataFrame, of: str) -> DataFrame:
        """Sets in order, so that equal ones are equal arrays, and their sizes; a union has nothing twice. A set's size asks for that set
        alone, so what nobody asks for isn't made."""
        a, b = (F.col(f"{of}{s}") for s in SCOPES[:2])
        every = F.array_union(a, b)
        number = lambda x: F.when(F.size(x) < 2, size(x)).otherwise(size(F.array_distinct(x)))
        return df.withColumns({f"{of}required": F.sort_array(a), f"{of}preferred": F.sort_array(b), f"{of}any_skill": F.sort_array(every), f"{of}required_n": number(a), f"{of}preferred_n": number(b), f"{of}any_skill_n": size(every)})

    p = predictions.select("job_id", "method", *(F.coalesce(c, nothing).alias(f"p_{c}") for c in ("required", "preferred")), *(F.col(c).alias(f"p_{c}") for c in ("work", "years")))
    # what depends on one side is made before they meet, so a posting's own once for all methods
    met = J.join(counted(gold, ""), counted(p, "p_"), ["job_id"], "one_to_many", misses)
    both = met.withColumns({f"p_{s}": F.coalesce(f"p_{s}", nothing) for s in SCOPES} | {f"p_{s}_n": F.coalesce(f"p_{s}_n", F.lit(0).cast("bigint")) for s in SCOPES})
    cols: dict[str, Column] = {}
    for s in SCOPES:
        exact = F.col(s) == F.col(f"p_{s}")
        tp = F.when(exact, F.col(f"{s}_n")).otherwise(size(F.array_intersect(s, f"p_{s}")))
        cols |= {f"{s}_tp": tp, f"{s}_fp": F.col(f"p_{s}_n") - tp, f"{s}_fn": F.col(f"{s}_n") - tp, f"{s}_exact": exact}
    # of the skills that both prefer, those that neither requires: none of them is among those that both require
    both_prefer = F.array_intersect("preferred", "p_preferred")
    neither = F.array_except(F.array_except(both_prefer, "required"), "p_required")
    right = cols["required_tp"] + F.when(cols["preferred_tp"] == 0, 0).otherwise(size(neither))
    g, y = F.col("years"), F.col("p_years")
    cols |= {
        "skill_type_overlap": cols["any_skill_tp"], "skill_type_correct": right, "work_correct": F.col("work") == F.col("p_work"),
        "years_exact": g.eqNullSafe(y), "years_within_1": F.coalesce(F.abs(g - y) <= 1.0, g.isNull() & y.isNull()), "years_abs_error": F.abs(g - y), "years_gold_stated": g.isNotNull(), "years_pred_answered": y.isNotNull(),
        "years_correct_abstention": g.isNull() & y.isNull(), "years_false_positive": g.isNull() & y.isNotNull(),
    }
    return both.select("job_id", "method", F.col("work").alias("gold_work"), F.col("p_work").alias("pred_work"), *(c.alias(n) for n, c in cols.items()))


def method_summary(items: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of each scope (F1 of nothing asked and nothing found is 1), and the rates of the
    other fields, by method. One aggregation of the items, by method and pair of arrangements, yields a few rows from which
    both the summary and the macro F1 of arrangements follow."""
    number = lambda c: F.col(c).cast("double")
    stated = F.col("years_gold_stated")
    rates = {
        "work_accuracy": number("work_correct"), "years_exact": number("years_exact"), "years_within_1": number("years_within_1"), "years_mae_answered": number("years_abs_error"), "years_answer_rate_when_stated": F.when(stated, number("years_pred_answered")),
        "years_correct_abstention": F.when(~stated, number("years_correct_abstention")), "years_false_positive_rate": F.when(~stated, number("years_false_positive")),
    }
    counts = [f"{s}_{c}" for s in SCOPES for c in ("tp", "fp", "fn")] + ["skill_type_correct", "skill_type_overlap"]
    parts = [F.sum(c).alias(c) for c in counts] + [x for n, c in rates.items() for x in (F.sum(c).alias(f"{n}_sum"), F.count(c).alias(f"{n}_n"))]
    cells = items.groupBy("method", "gold_work", "pred_work").agg(F.count("*").alias("n"), *parts)
    # no cell is empty; the condition names all columns, so both uses have the same cells, whatever is asked of them
    cells = cells.where((F.col("n") > 0) | (F.xxhash64(*cells.columns) != 0))
    aggs = []
    for s in SCOPES:
        tp, fp, fn = (F.sum(f"{s}_{c}") for c in ("tp", "fp", "fn"))
        aggs += [rounded(ratio(tp, tp + fp), 4).alias(f"{s}_precision"), rounded(ratio(tp, tp + fn), 4).alias(f"{s}_recall"), rounded(f1_or(tp, fp, fn, 1.0), 4).alias(f"{s}_f1")]
    over = lambda a, b: rounded(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 4)
    aggs += [over("skill_type_correct", "skill_type_overlap").alias("skill_type_accuracy"), *(over(f"{n}_sum", f"{n}_n").alias(n) for n in rates)]
    sums = cells.groupBy("method").agg(F.sum("n").alias("n_jobs"), *aggs)
    macro = macro_f1(cells, ["method"], "gold_work", "pred_work", None, 1.0, "n")
    return sums.join(macro.withColumnRenamed("macro_f1", "work_macro_f1"), "method")


def long_metrics(summary: DataFrame) -> DataFrame:
    """A summary with one row a metric."""
    return summary.unpivot(["method", "n_jobs"], [c for c in summary.columns if c not in ("method", "n_jobs")], "metric", "value")


def winners(long: DataFrame, lower_is_better: tuple = ("years_mae_answered", "years_false_positive_rate")) -> DataFrame:
    """The method with the best value of each metric; ties go to the first name."""
    worth = F.when(F.col("metric").isin(*lower_is_better), -F.col("value")).otherwise(F.col("value"))
    return long.where("value is not null").groupBy("metric").agg(F.min_by(F.struct("method", "value"), F.struct((-worth).alias("w"), "method")).alias("x")).select("metric", "x.method", "x.value")


def tied_winners(long: DataFrame, lower_is_better: tuple = ("years_mae_answered", "years_false_positive_rate")) -> DataFrame:
    """Every method with the best value of each metric: ``metric, value, methods, n_tied``."""
    worth = F.when(F.col("metric").isin(*lower_is_better), -F.col("value")).otherwise(F.col("value"))
    top = long.where("value is not null").groupBy("metric", worth.alias("w"), "value").agg(F.array_sort(F.collect_list("method")).alias("m"))  # a row a method at most
    best = top.groupBy("metric").agg(F.max_by(F.struct("value", "m"), "w").alias("x"))
    return best.select("metric", "x.value", F.array_join("x.m", ",").alias("methods"), F.size("x.m").alias("n_tied"))


ERRORS = {"required": "required_exact", "preferred": "preferred_exact", "any_skill": "any_skill_exact", "work": "work_correct", "years": "years_exact"}


def error_counts(items: DataFrame) -> DataFrame:
    """Errors of each field and their rates, by method, in the usual order of methods (``place``)."""
    sums = items.groupBy("method").agg(F.count("*").alias("postings"), *(F.count_if(~F.col(c)).alias(f"{n}_errors") for n, c in ERRORS.items()))
    rates = {f"{n}_error_rate": rounded(F.col(f"{n}_errors") / F.col("postings"), 6) for n in ERRORS}
    return in_method_order(sums).withColumns(rates)


def in_method_order(rows: DataFrame) -> DataFrame:
    """``place``: known methods in their usual order, others after them by name (rows: one a method)."""
    known = F.array_position(F.array(*map(F.lit, METHOD_ORDER)), F.col("method"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.when(known == 0, len(METHOD_ORDER) + 1).otherwise(known), "method")))


def evidence_consistency(predictions: DataFrame, value: str = "salary_min", evidence: str = "evidence_salary") -> DataFrame:
    """How often a method quotes evidence but gives no value, by method."""
    quoted = N.stripped(F.coalesce(evidence, F.lit(""))) != ""
    sums = predictions.groupBy("method").agg(F.count_if(quoted).alias("quoted"), F.count_if(quoted & F.col(value).isNull()).alias("value_null"))
    return sums.withColumn("inconsistency_pct", rounded(100.0 * F.col("value_null") / F.greatest("quoted", F.lit(1)), 1))


def model_costs(staged: DataFrame) -> DataFrame:
    """What the recorded run cost (cached replies are free) against what its tokens would cost anew, by model."""
    n = F.count("*")
    return staged.where("method <> 'rules'").groupBy("method").agg(n.alias("predictions"), rounded(F.sum(F.when(F.col("cached"), 0.0).otherwise(F.col("cost_usd"))), 6).alias("recorded_run_cost_usd"), rounded(F.sum("cost_usd"), 6).alias("estimated_model_cost_usd"), rounded(F.sum("cost_usd") / n * 1000, 3).alias("estimated_cost_per_1k"))


def best_against_others(scored: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """The model with the best sum of level F1 and salary hits, and the others against it: salary and level outcomes by paired
    intervals and exact tests. Differences are the other's less the best's."""
    own = scored.where("method <> 'rules'")
    f1 = macro_f1(own.where("gt_seniority is not null"), ["method"], "gt_seniority", "seniority", LEVELS)
    hits = own.where("stratum = 'labeled_stated'").groupBy("method").agg(F.avg(F.coalesce("salary_within_10pct", F.lit(False)).cast("double")).alias("hits"))
    top = f1.join(hits, "method").orderBy(F.desc(F.col("macro_f1") + F.col("hits")), "method").limit(1).first()  # one row
    if top is None:
        return scored.sparkSession.createDataFrame([], "metric string, method string, n bigint, difference double, ci_low double, ci_high double, excludes_zero boolean, p_raw double, best string")
    flags = {"salary": F.when(F.col("stratum") == "labeled_stated", F.coalesce("salary_within_10pct", F.lit(False))), "seniority": F.when(F.col("gt_seniority").isNotNull(), F.coalesce("seniority_correct", F.lit(False)))}
    outcomes = own.select("job_id", "method", *(c.cast("int").alias(n) for n, c in flags.items()))
    spread = R.bootstrap(R.cells(outcomes, {m: R.mean(m) for m in flags}), top.method, draws, seed)
    exact = mcnemar(paired(outcomes, list(flags), top.method)).select("metric", "method", "p_raw")
    return spread.join(exact, ["metric", "method"]).withColumn("best", F.lit(top.method))


def top_extra(gold: DataFrame, predictions: DataFrame, most: int = 12) -> DataFrame:
    """The skills that each method names most without being asked."""
    g = gold.select("job_id", F.array_union("required", "preferred").alias("g"))
    extra = predictions.select("job_id", "method", F.array_union("required", "preferred").alias("p")).join(g.hint("merge"), "job_id").select("method", F.explode(F.array_except("p", "g")).alias("skill"))
    counted = extra.groupBy("method", "skill").agg(F.count("*").alias("extra"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("method").orderBy(F.desc("extra"), "skill"))).where(F.col("rank") <= most)


def top_missed(gold: DataFrame, predictions: DataFrame, most: int = 12) -> DataFrame:
    """The skills that each method misses most."""
    p = predictions.select("job_id", "method", F.array_union("required", "preferred").alias("p"))
    missed = gold.select("job_id", F.array_union("required", "preferred").alias("g")).join(p.hint("merge"), "job_id").select("method", F.explode(F.array_except("g", "p")).alias("skill"))
    counted = missed.groupBy("method", "skill").agg(F.count("*").alias("missed"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("method").orderBy(F.desc("missed"), "skill"))).where(F.col("rank") <= most)


# --- tests -------------------------------------------------------------------------------------------

def paired(items: DataFrame, metrics: list[str], baseline: str) -> DataFrame:
    """``method, metric, candidate_only, baseline_only, n``: discordant pairs of 0/1 outcomes with the baseline, by one
    aggregation an item instead of a self-join, before metrics become rows: items that lie by key already are neither exchanged nor
    sorted. Null outcomes leave the pair out."""
    hits = items.select("job_id", "method", *(F.col(m).cast("int").alias(f"_h{i}") for i, m in enumerate(metrics)))
    by, own = Window.partitionBy("job_id"), F.col("method") == baseline
    beside = hits.withColumns({f"_b{i}": F.max(F.when(own, F.col(f"_h{i}"))).over(by) for i in range(len(metrics))}).where(~own)
    both = beside.select("method", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_h{i}").alias("hit"), F.col(f"_b{i}").alias("base")) for i, m in enumerate(metrics)]))).where("hit is not null and base is not null")
    return both.groupBy("method", "metric").agg(F.count_if(F.expr("hit = 1 and base = 0")).alias("candidate_only"), F.count_if(F.expr("hit = 0 and base = 1")).alias("baseline_only"), F.count("*").alias("n"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Exact two-sided test, and the difference of the accuracies."""
    return pairs.withColumns({"p_raw": binomial_two_sided(F.col("candidate_only"), F.col("baseline_only")), "difference": (F.col("candidate_only") - F.col("baseline_only")) / F.col("n")})


def holm(tests: DataFrame, name: list[str], family: list[str] | None = None, p: str = "p_raw", alpha: float = 0.05) -> DataFrame:
    """Step-down correction within each family (all tests, if none is given); one row a test."""
    by = Window.partitionBy(*(family or [F.lit(1)]))
    order = by.orderBy(p, *name)
    step = tests.withColumn("_step", F.least(F.lit(1.0), F.col(p) * (F.count("*").over(by) - F.row_number().over(order) + 1)))
    out = step.withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
    return out.withColumn("significant", F.col("p_holm") <= alpha)


# --- policies ------------------------------------------------------------------------------------------

def routed(scored: DataFrame, model: str = "schema_rules", rules: str = "rules") -> DataFrame:
    """Three policies for the level over the same postings: the rules alone, a model alone, the model only where the
    rules are silent; accuracy, answers, calls, cost, and how often the rules fired and abstained."""
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("seniority")))
    items = scored.where(F.col("method").isin(rules, model) & F.col("gt_seniority").isNotNull()).groupBy("job_id").agg(F.first("gt_seniority").alias("truth"), of(rules).alias("r"), of(model).alias("m"))
    policy = lambda name, said, call: F.struct(F.lit(name).alias("policy"), said.alias("said"), call.cast("bigint").alias("call"))
    every = F.array(policy("rules only", F.col("r"), F.lit(False)), policy("model only", F.col("m"), F.lit(True)), policy("rules first", F.coalesce("r", "m"), F.col("r").isNull()))
    n = F.count("*")
    return items.select("truth", "r", F.inline(every)).groupBy("policy").agg(n.alias("n"), rounded(F.avg((F.coalesce(F.col("said") == F.col("truth"), F.lit(False))).cast("double")), 4).alias("accuracy"), rounded(F.avg(F.col("said").isNotNull().cast("double")), 4).alias("answer_rate"), F.sum("call").alias("calls"), rounded(1000 * F.sum("call") / n * COST_PER_CALL, 4).alias("cost_per_1k"), F.count("r").alias("rules_fired"), (n - F.count("r")).alias("rules_abstained"))


def best_variant(summary: DataFrame, metric: str, baseline: str = "rules") -> DataFrame:
    """The best method beside the baseline; ties go to the first name."""
    return summary.where(F.col("method") != baseline).orderBy(F.desc(metric), "method").limit(1)


# --- item consensus (events) -----------------------------------------------------------------------------

def consensus(extractions: DataFrame, within: float = 0.2) -> DataFrame:
    """Each method's value against the item's consensus (the median)."""
    truth = extractions.groupBy("item_id").agg(F.median("value").alias("truth"))  # a value a method
    off = F.abs(F.col("value") - F.col("truth"))
    return extractions.join(truth, "item_id").withColumns({"error": off, "correct": (off <= within * F.col("truth")).cast("int")})
