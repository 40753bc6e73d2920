"""Joins with contracts, pattern tables, reply caches, reconciliation, bucketed layers and paired tests as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources as S
from ..operators import columns as L
from ..operators import contracts as J
from ..operators import market as M
from ..operators import patterns as P
from ..operators import reconcile as R
from ..operators import replies as A
from ..operators import resampling as B
from ..operators import scoring as C
from ..sources import files, layers, seeds
from .market import _MENTIONS, facts, roles
from .market import SQL as MARKET_SQL
from .scores import _FOUND, _GOLD, _ITEMS, _PAIRS, items

#: Draws of the registered intervals, which SQL repeats weight by weight.
DRAWS, SEED = 100, 42


# --- patterns as a table ------------------------------------------------------------------------------

def pattern_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptions of data roles joined with the seed table of patterns."""
    own = roles(spark, sf_dir).select("job_id", "description")
    return P.matches(own, seeds.skill_patterns(spark), "job_id", "description", "skill_name", "regex_pattern")


def pattern_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined with as many patterns as ``benchmark`` has rows: the first four words of each, with any white space between."""
    words = F.slice(F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda w: w != ""), 1, 4)
    rules = S.table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit(r"(?i)\b"), F.array_join(words, r"\s+"), F.lit(r"\b")).alias("pattern")).where(F.size(words) == 4)
    return P.matches(S.table(spark, sf_dir, "documents"), rules, "doc_id", "text", "item_id", "pattern")


# --- joins with a contract ------------------------------------------------------------------------------

def _methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in S.METHODS], "method string")


def predictions_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every annotated posting with every method, missing predictions kept."""
    given = S.found(spark, sf_dir).where("not (method = 'few_shot' and job_id % 50 = 0)")
    return J.complete(given, S.gold(spark, sf_dir).select("job_id"), _methods(spark), "job_id", "method").select("job_id", "method", "work_arrangement", "years_experience_min", "missing")


def same_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that annotations and all methods have alike, by a job that fails if they don't."""
    by = S.found(spark, sf_dir)
    return J.same_ids({"gold": S.gold(spark, sf_dir), **{m: by.where(F.col("method") == m) for m in S.METHODS}}, "job_id")


# --- columns by several names ------------------------------------------------------------------------------

RENAMED = {"job_id": "posting_id", "method": "extractor", "required_skills": "skills_required", "preferred_skills": "nice_to_have_skills", "work_arrangement": "workplace_type", "years_experience_min": "years_min"}


def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions whose columns go by other names, scored as under their own."""
    other = S.found(spark, sf_dir).withColumnsRenamed(RENAMED).withColumn("note", F.lit("x"))
    return C.score_items(C.standardised(S.gold(spark, sf_dir), False), C.standardised(L.standardised(other), True))


# --- tables compared ----------------------------------------------------------------------------------

def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy with rows lost, added, repeated and changed, and prices off by less than the tolerance."""
    own = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    price = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") * (1 + 1e-13)).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderkey") % 89 != 0, F.col("o_orderstatus"))
    times = F.when(F.col("o_orderkey") % 101 == 0, 0).when(F.col("o_orderkey") % 83 == 0, 2).otherwise(1)
    copy = own.select("o_orderkey", status.alias("o_orderstatus"), price.alias("o_totalprice"), "o_custkey", F.explode(F.array_repeat(F.lit(1), times)).alias("_")).drop("_")
    more = own.where("o_orderkey % 103 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    return R.differences(own, copy.unionByName(more), ["o_orderkey"])


# --- replies ---------------------------------------------------------------------------------------------

COST_IN, COST_OUT = C.COST_IN, C.COST_OUT


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' turns as prompts, dealt to two models."""
    turns = S.table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), F.when(F.col("turn") % 4 == 0, "small").otherwise("large").alias("model"), F.col("text").alias("prompt"), "turn")


def called(misses: DataFrame) -> DataFrame:
    """Stands in for a model: replies are a function of model and prompt."""
    return misses.select("key", F.upper(F.concat_ws(":", "model", F.substring("prompt", 1, 20))).alias("reply"), F.length("prompt").cast("bigint").alias("input_tokens"), (F.length("prompt") % 50 + 1).cast("bigint").alias("output_tokens"))


def reply_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of requests against one cache: the first turns, then all. The first round is sent twice and pays once."""
    cache, every = A.Cache(spark, files.shared_folder(spark, "replies")), requests(spark, sf_dir)
    answer = lambda name, rows: A.usage(cache.answer(name, rows, called, COST_IN, COST_OUT), ["model"]).withColumn("round", F.lit(name))
    first = every.where("turn < 2")
    answer("first", first)
    return answer("first", first).unionByName(answer("second", every))


# --- layers -----------------------------------------------------------------------------------------------

def bucketed(spark: SparkSession, sf_dir: str, codes: DataFrame, keys: list[str], remote: bool) -> DataFrame:
    """A breakdown by code from tables that are laid out by job."""
    layer = f"layer_{uuid.uuid4().hex}"
    made = layers.write_all({"facts": facts(spark, sf_dir).select("job_id", "has_valid_salary", "annualized_salary_usd", "remote_status"), "codes": codes}, "job_id", layers.BUCKETS, layer)
    return M.by_code(made["facts"], made["codes"], keys, remote)


# --- paired tests -----------------------------------------------------------------------------------------

def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in names})


def bootstrap_of(spark: SparkSession, sf_dir: str, **metrics) -> DataFrame:
    found = B.bootstrap(B.cells(items(spark, sf_dir), metrics), "rules", DRAWS, SEED)
    return _rounded(found, "difference", "ci_low", "ci_high")


BINARY = ["work_correct", "years_exact", "years_within_1"]
FAMILY = {"required_f1": "required", "preferred_f1": "preferred", "any_skill_f1": "any_skill"}


def pairwise_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of all comparisons with the rules: intervals of the three skill scores, exact tests of the three yes-or-no
    outcomes, the latter corrected within each outcome."""
    scores = bootstrap_of(spark, sf_dir, **{m: B.micro_f1(s) for m, s in FAMILY.items()})
    exact = C.holm(C.mcnemar(C.paired(items(spark, sf_dir), BINARY, "rules")), ["method"], ["metric"])
    exact = _rounded(exact, "difference", "p_raw", "p_holm").select("metric", "method", "n", "difference", "p_raw", "p_holm", "significant")
    told = scores.select("metric", "method", "n", "difference", "ci_low", "ci_high", F.col("excludes_zero").alias("significant"))
    return told.withColumn("test", F.lit("paired bootstrap")).unionByName(exact.withColumn("test", F.lit("exact binomial")), allowMissingColumns=True)


QUERIES = {
    "pattern_mentions": pattern_mentions,
    "pattern_passages": pattern_passages,
    "predictions_complete": predictions_complete,
    "same_postings": same_postings,
    "renamed_columns": renamed_columns,
    "table_differences": table_differences,
    "reply_cache": reply_cache,
    "market_industries_bucketed": lambda s, d: bucketed(s, d, S.job_industries(s, d), ["industry_id", "industry_name"], True),
    "market_skill_categories_bucketed": lambda s, d: bucketed(s, d, S.job_skills(s, d), ["skill_abr", "skill_name"], False),
    "paired_bootstrap": lambda s, d: bootstrap_of(s, d, years_exact=B.mean("years_exact")),
    "bootstrap_micro_f1": lambda s, d: bootstrap_of(s, d, required_f1=B.micro_f1("required")),
    "pairwise_tests": pairwise_tests,
}

_R6 = lambda c: f"round({c} * 1e6) / 1e6"


def _drawn(metrics: dict[str, tuple[str, str]], head: str = _ITEMS, base: str = "'rules'") -> str:
    """Intervals by the same weights: the k-th threshold is where the Poisson distribution passes k."""
    cells = " union all ".join(f"select job_id, method, '{m}' metric, cast({n} as double) num, cast({d} as double) den from it" for m, (n, d) in metrics.items())
    weight = " + ".join(f"cast(u >= {t} as int)" for t in B.THRESHOLDS)
    ratio = lambda a, b: f"case when {b} > 0 then {a} / {b} else 1.0 end"
    return f"""{head}, ce as (select * from ({cells}) where num is not null and den is not null),
 pr as (select o.job_id, o.metric, o.method, o.num, o.den, r.num bnum, r.den bden from ce o join ce r on o.job_id = r.job_id and o.metric = r.metric and r.method = {base} where o.method <> {base}),
 dr as (select job_id, k, cast('0x' || substr(md5('{SEED}:' || job_id || ':' || (k // 4)), 8 * (k % 4) + 1, 8) as bigint) u from (select distinct job_id from pr), (select unnest(range({DRAWS})) k)),
 wt as (select job_id, k, {weight} w from dr),
 sp as (select metric, method, k, sum(num * w) a, sum(den * w) b, sum(bnum * w) c, sum(bden * w) d from pr join wt using (job_id) where w > 0 group by all),
 ci as (select metric, method, quantile_cont({ratio('a', 'b')} - {ratio('c', 'd')}, 0.025) lo, quantile_cont({ratio('a', 'b')} - {ratio('c', 'd')}, 0.975) hi from sp group by all),
 po as (select metric, method, count(*) n, sum(num) a, sum(den) b, sum(bnum) c, sum(bden) d from pr group by all),
 bo as (select metric, method, n, {_R6(f"({ratio('a', 'b')} - {ratio('c', 'd')})")} difference, {_R6('lo')} ci_low, {_R6('hi')} ci_high, lo > 0 or hi < 0 excludes_zero from po join ci using (metric, method))"""


_F1 = {m: (f"2 * {s}_tp", f"2 * {s}_tp + {s}_fp + {s}_fn") for m, s in FAMILY.items()}
_EXACT = _PAIRS.removeprefix(_ITEMS).lstrip(", \n")
_COPY = """a as (select o_orderkey, o_orderstatus, o_totalprice, o_custkey from orders),
 b0 as (select o_orderkey, case when o_orderkey % 89 <> 0 then o_orderstatus end o_orderstatus, case when o_orderkey % 97 = 0 then o_totalprice + 1 else o_totalprice end o_totalprice, o_custkey from a where o_orderkey % 101 <> 0),
 b as (select b0.* from b0 union all select b0.* from b0 where o_orderkey % 83 = 0 union all select -o_orderkey, o_orderstatus, o_totalprice, o_custkey from a where o_orderkey % 103 = 0)"""
_ASKED = "q as (select model, md5(model || chr(0) || prompt) k, prompt, turn, request_id, cast(length(prompt) as bigint) i, cast(length(prompt) % 50 + 1 as bigint) o from (select cast(conv_id as varchar) || '-' || turn request_id, case when turn % 4 = 0 then 'small' else 'large' end model, coalesce(text, '') prompt, turn from conversations where role = 'user'))"


def _round(name: str, where: str, known: str) -> str:
    return f"""select '{name}' as round, model, count(*) requests, count(*) filter (where pays) calls, count(*) filter (where not pays) cached, cast(0 as bigint) failed, cast(coalesce(sum(i) filter (where pays), 0) as bigint) input_tokens, cast(coalesce(sum(o) filter (where pays), 0) as bigint) output_tokens, round(coalesce(sum(i / 1e6 * {COST_IN} + o / 1e6 * {COST_OUT}) filter (where pays), 0), 6) cost_usd
 from (select *, k not in ({known}) and row_number() over (partition by k order by request_id) = 1 pays from q where {where}) group by model"""


SQL = {
    "pattern_mentions": f"with {_MENTIONS} select job_id, skill_name from m",
    "pattern_passages": r"with p as (select item_id, '(?i)\b' || array_to_string(w[1:4], '\s+') || '\b' p from (select item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') w from benchmark) where len(w) >= 4) select doc_id, item_id from documents join p on regexp_matches(text, p)",
    "predictions_complete": f"with {_GOLD}, {_FOUND} select job_id, method, case when not missing then work_arrangement end work_arrangement, case when not missing then years_experience_min end years_experience_min, missing from (select *, method = 'few_shot' and job_id % 50 = 0 missing from f0)",
    "same_postings": "select o_orderkey job_id from orders",
    "renamed_columns": f"with {_ITEMS} select * from it",
    "table_differences": f"""with {_COPY}, c as (select o_orderkey, count(*) n, min(o_orderstatus) s, min(o_totalprice) p, min(o_custkey) k from b group by 1),
 d as (select coalesce(a.o_orderkey, c.o_orderkey) o_orderkey, case when c.o_orderkey is null then 'left_only' when a.o_orderkey is null then 'right_only' when n > 1 then 'repeated' when s is distinct from o_orderstatus or abs(p - o_totalprice) > 0.5 then 'changed' end status, concat_ws(',', case when s is distinct from o_orderstatus then 'o_orderstatus' end, case when abs(p - o_totalprice) > 0.5 then 'o_totalprice' end) ch, case when a.o_orderkey is null then 0 else 1 end left_rows, coalesce(n, 0) right_rows from a full join c on a.o_orderkey = c.o_orderkey)
 select o_orderkey, status, case when status = 'changed' then ch end as columns, cast(left_rows as bigint) left_rows, right_rows from d where status is not null""",
    "reply_cache": f"with {_ASKED} {_round('first', 'turn < 2', 'select null where false')} union all {_round('second', 'true', 'select k from q where turn < 2')}",
    "market_industries_bucketed": MARKET_SQL["market_industries"],
    "market_skill_categories_bucketed": MARKET_SQL["market_skill_categories"],
    "paired_bootstrap": f"with {_drawn({'years_exact': ('cast(years_exact as int)', 'case when years_exact is not null then 1 end')})} select * from bo",
    "bootstrap_micro_f1": f"with {_drawn({'required_f1': _F1['required_f1']})} select * from bo",
    "pairwise_tests": f"with {_drawn(_F1)}, {_EXACT}, ho as (select *, max(h_) over (partition by metric order by p, method rows between unbounded preceding and current row) ph from (select *, least(1.0, p * (count(*) over (partition by metric) - row_number() over (partition by metric order by p, method) + 1)) h_ from te)) select metric, method, n, difference, ci_low, ci_high, excludes_zero significant, null::double p_raw, null::double p_holm, 'paired bootstrap' test from bo union all select metric, method, n, {_R6('difference')}, null, null, ph <= 0.05, {_R6('p')}, {_R6('ph')}, 'exact binomial' from ho",
}
