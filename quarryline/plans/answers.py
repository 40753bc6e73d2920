"""Answers, errors, costs and samples as queries. The inputs are texts and columns of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources as S
from ..functions import quantiles
from ..operators import datasets as D
from ..operators import extract as E
from ..operators import market as M
from ..operators import normalise as N
from ..operators import scoring as C
from .common import BASE, RAW, ROLES
from .datasets import _BENCH, benchmark
from .market import SQL as MARKET_SQL
from .market import roles
from .scores import _FOUND, _ITEMS, _LONG, _PREDICTED, _SCORED, items, predictions, scored
from .tables import _R6, _drawn
from .texts import SQL as TEXT_SQL

DRAWS = 100

# --- replies made of what users and assistants wrote -------------------------------------------------------------

#: What a reply about the arrangement says, by the length of the turn.
_SAYS = ["Fully Remote", " HYBRID ", "in-office", "Not stated", "anywhere"]
_MEANS = ["remote", "hybrid", "onsite", "unclear", None]


def arrangement_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn quoted as evidence in a reply: with a fence, with words around it, in the first stage, or broken off."""
    t = S.table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("reply_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    said = F.element_at(F.array(*map(F.lit, _SAYS)), (n % 5 + 1).cast("int"))
    first = F.struct(F.col("text").alias("role_specific_arrangement_text"))
    own = F.to_json(F.struct(said.alias("work_arrangement"), F.when(n % 2 == 0, F.col("text")).otherwise("").alias("evidence_work_arrangement"), first.alias("stage1_evidence")))
    reply = F.when(n % 7 == 0, F.concat(F.lit("```json\n"), own, F.lit("\n```"))).when(n % 7 == 1, F.concat(F.lit("Here it is: "), own, F.lit(" - done"))).when(n % 7 == 2, F.concat(F.lit("["), own, F.lit("]"))).when(n % 7 == 3, F.substring(own, 2, 10_000_000)).otherwise(own)
    got = N.arrangement_replies(t.select("reply_id", reply.alias("reply")))
    return got.select("reply_id", "work_arrangement", F.md5("evidence_work_arrangement").alias("evidence_md5"), "valid_json", "valid_arrangement", F.col("validation_error"))


def evidence_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around the last word of ten characters of each document, a digest of it."""
    d = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    quoted = F.regexp_extract("text", r"^[^\n]*[^a-z\n]([a-z]{10})[^a-z]", 1)
    got = d.select("doc_id", N.evidence_context(F.col("text"), quoted).alias("x"))
    return got.select("doc_id", F.length("x").alias("n"), F.md5("x").alias("digest"))


def document_skill_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names of what documents hold between blanks, and in how many places."""
    words = S.table(spark, sf_dir, "documents").where("text is not null").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).select(N.canonical_skill(F.col("w")).alias("skill"), "n").groupBy("skill").agg(F.sum("n").alias("n"))


def document_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read as lists."""
    t = S.table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", N.parse_list(F.col("text")).alias("x")).select("conv_id", "turn", F.size("x").alias("n"), F.md5(F.array_join("x", "\x1f")).alias("digest"))


def document_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and turns read as answers about years and arrangement."""
    d = S.table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "text").unionByName(S.table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), "text"))
    return d.select("source", N.years(F.col("text")).alias("years"), N.work(F.col("text")).alias("work")).groupBy("source", "years", "work").agg(F.count("*").alias("n"))


# --- records, samples, prompts -------------------------------------------------------------------------------------

def posting_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.once(S.raw_postings(spark, sf_dir, True).select("job_id", "title", "description"), "job_id", ["title", "description"], lambda p: E.records(p, "title", "description"))
    return r.select("job_id", "salary_min", "salary_max", "pay_period", "years_experience_min", "seniority", "work_arrangement", F.array_join("required_skills", ",").alias("required"), F.array_join("preferred_skills", ",").alias("preferred"), "n_required", "n_preferred", F.size("evidence").alias("n_evidence"))


def diagnostic_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diagnostic_rows(S.raw_postings(spark, sf_dir, True).select("job_id", "title", "description"), S.gold(spark, sf_dir)).select("job_id", "title")


#: Prompts of our own, by variant.
TEMPLATES = {
    "plain": "State pay, seniority and skills of this posting as JSON.\nTitle: {title}\nText:\n{description}\n",
    "strict": "Read the posting and answer with one JSON object. Leave out nothing; use null for what isn't stated.\nTitle: {title}\nText:\n{description}\nJSON:",
    "steps": "First quote every passage about pay, then about experience, then about place of work. Then answer as JSON.\n{title}\n{description}\n",
}


def prompt_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = D.prompts(S.raw_postings(spark, sf_dir, True), TEMPLATES)
    return D.dry_run(asked, C.COST_IN, C.COST_OUT).withColumn("variant", F.coalesce("variant", F.lit("all")))


def quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with evidence: the clerk's text of the order, blank for some."""
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_custkey") % 3 == 0, " \t").when(F.col("o_custkey") % 3 == 1, F.col("o_orderpriority")).alias("evidence_salary"))
    return predictions(spark, sf_dir).join(o, "job_id")


def rounded_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.best_against_others(scored(spark, sf_dir), DRAWS)
    return found.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in ("difference", "ci_low", "ci_high", "p_raw")})


def titles_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings whose title is like each of some patterns."""
    raw = S.raw_postings(spark, sf_dir)
    each = F.array(*(F.when(F.col("title").like(p), F.lit(p)) for p in LIKE))
    return raw.select(F.explode(F.array_compact(each)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


LIKE = ["Senior%", "%Data%", "%Analyst", "_ata %", "%100\\%%"]

QUERIES = {
    "arrangement_replies": arrangement_replies,
    "evidence_contexts": evidence_contexts,
    "document_skill_names": document_skill_names,
    "document_lists": document_lists,
    "document_years": document_years,
    "posting_records": posting_records,
    "diagnostic_postings": diagnostic_postings,
    "prompt_costs": prompt_costs,
    "error_counts": lambda s, d: C.error_counts(items(s, d)),
    "metric_ties": lambda s, d: C.tied_winners(C.long_metrics(C.method_summary(items(s, d)))),
    "evidence_consistency": lambda s, d: C.evidence_consistency(quoting(s, d)),
    "model_costs": lambda s, d: C.model_costs(predictions(s, d)),
    "best_variant_tests": rounded_best,
    "top_extra_skills": lambda s, d: C.top_extra(C.standardised(S.gold(s, d), False), C.standardised(S.found(s, d), True)),
    "benchmark_composition": lambda s, d: D.composition(benchmark(s, d), ["stratum", "pay_bucket"]),
    "role_skills_ranked": lambda s, d: M.ranked_skills(M.role_skills(roles(s, d), M.skill_mentions(roles(s, d)))),
    "titles_like": titles_like,
    "salary_error_quantiles": lambda s, d: quantiles(scored(s, d).where("stratum = 'labeled_stated'"), ["method"], "salary_pct_error", {"median_error": 0.5, "p90_error": 0.9}, 4),
}

_CASE = lambda xs: "[" + ", ".join("null" if x is None else f"'{x}'" for x in xs) + "]"
_SKILL = "[" + ", ".join(f"{{'a': '{a}', 'b': '{b}'}}" for a, b in N.SKILL_ALIASES.items()) + "]"
_OUTER = r"regexp_replace({0}, '^[ .,:;()\[\]{{}}]+|[ .,:;()\[\]{{}}]+$', '', 'g')"
_WS = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ANSWERS = f"[{', '.join(repr(x) for x in N.NO_YEARS)}]"
_PLACE = "case when t like '%hybrid%' then 'Hybrid' when regexp_matches(t, 'on-site|onsite|on site|in-office|in office') then 'Onsite' when regexp_matches(t, 'remote|work from home|wfh') then 'Remote' else 'Unclear' end"
_EXACT_ALIAS = "case t " + " ".join(f"when '{a}' then '{b}'" for a, b in N.WORK_ALIASES.items()) + f" else {_PLACE} end"
_FACTS = {n: f"({TEXT_SQL[f'extract_{n}']})" for n in ("salary", "seniority", "years", "arrangement", "skills")}
_SIZE = lambda c: f"cast(len(list_filter(string_split({c}, ','), lambda x: x <> '')) as int)"
_EDGES = {v: len(t) - len("{title}") - len("{description}") for v, t in TEMPLATES.items()}

_BEST = f"""{_SCORED}, own as (select * from sc where method <> 'rules'), cl as (select method, class, count(case when gt_seniority = class and seniority = class then 1 end) tp, count(case when gt_seniority = class then 1 end) g, count(case when seniority = class then 1 end) p from own, (select unnest({_CASE(C.LEVELS)}) as class) where gt_seniority is not null group by 1, 2),
 fs as (select method, round(avg(if(g + p = 0, 0, 2.0::double * tp / (g + p))), 4) f from cl group by 1), hs as (select method, avg(if(coalesce(salary_within_10pct, false), 1, 0)) h from own where stratum = 'labeled_stated' group by 1), best as (select method from fs join hs using (method) order by f + h desc, method limit 1),
 it as (select job_id, method, if(stratum = 'labeled_stated', coalesce(salary_within_10pct, false)::int, null) salary, if(gt_seniority is null, null, coalesce(seniority_correct, false)::int) seniority from own)"""

SQL = {
    "arrangement_replies": f"""with t as (select cast(conv_id as varchar) || '-' || turn reply_id, coalesce(text, '') text, length(coalesce(text, '')) n from conversations),
 u as (select *, n % 7 <> 2 and n % 7 <> 3 good, {_CASE(_MEANS)}[n % 5 + 1] l from t) select reply_id, if(good, l, null) work_arrangement, if(good and coalesce(l, '') <> 'unclear' and text <> '', md5(text), null) evidence_md5, good valid_json, good and l is not null valid_arrangement,
 case when n % 7 = 2 then 'JSON, but no object' when n % 7 = 3 then case when n % 7 = 3 then 'no JSON' end when l is null then 'Invalid work_arrangement value: ''anywhere''' end validation_error from u""",
    "evidence_contexts": rf"""with q as (select doc_id, text, regexp_extract(text, '^[^\n]*[^a-z\n]([a-z]{{10}})[^a-z]', 1) w from documents), p as (select *, instr(text, w) i from q),
 c as (select doc_id, case when text is null then '' when w = '' then regexp_replace(regexp_replace(substr(text, 1, 130), '{_WS}', ' ', 'g'), '^ | $', '', 'g') else regexp_replace(regexp_replace(substr(text, greatest(i - 130, 1), i - greatest(i - 130, 1) + 10 + 130), '{_WS}', ' ', 'g'), '^ | $', '', 'g') end x from p) select doc_id, cast(length(x) as int) n, md5(x) digest from c""",
    "document_skill_names": rf"""with w as (select w, count(*) n from (select unnest(string_split(text, ' ')) w from documents where text is not null) group by 1), a as (select n, regexp_replace(regexp_replace(regexp_replace(replace(lower(regexp_replace(w, '^{_WS}|{_WS}$', '', 'g')), '&', ' and '), '[™®]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), '^(python|tableau|excel|spark) $', '\1 ') t from w),
 b as (select n, regexp_replace({_OUTER.format('t')}, '^(python|tableau|excel|spark)[ \t\n\x0B\f\r]+[0-9]+(?:\.[0-9]+)*$', '\1') t from a) select coalesce(list_filter({_SKILL}, lambda x: x.a = t)[1].b, t) skill, cast(sum(n) as bigint) n from b group by 1""",
    "document_lists": f"""with t as (select conv_id, turn, regexp_replace(text, '^{_WS}|{_WS}$', '', 'g') t from conversations), x as (select conv_id, turn, case when t is null or list_contains({_CASE(N.NO_LIST)}, lower(t)) then [] else list_filter(list_transform(regexp_split_to_array(t, '[,;|\\n]'), lambda i: regexp_replace(i, '^{_WS}|{_WS}$', '', 'g')), lambda i: i <> '') end x from t)
 select conv_id, turn, cast(len(x) as int) n, md5(array_to_string(x, chr(31))) digest from x""",
    "document_years": f"""with d as (select 'documents' source, text from documents union all select 'conversations', text from conversations),
 t as (select source, lower(regexp_replace(text, '^{_WS}|{_WS}$', '', 'g')) y, lower(regexp_replace(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'), '^ | $', '', 'g')) t from d)
 select source, case when not list_contains({_ANSWERS}, y) then try_cast(nullif(regexp_extract(replace(y, ',', ''), '[0-9]+(?:\\.[0-9]+)?'), '') as double) end as years, {_EXACT_ALIAS} as work, count(*) n from t group by all""",
    "posting_records": f"""select job_id, low salary_min, high salary_max, period pay_period, least years_experience_min, level seniority, arrangement work_arrangement, required, preferred, {_SIZE('required')} n_required, {_SIZE('preferred')} n_preferred, cast(n_evidence as int) + cast(low is not null as int) + cast(level is not null as int) + cast(least is not null as int) + cast(arrangement <> 'unclear' as int) n_evidence
 from {_FACTS['salary']} join {_FACTS['seniority']} using (job_id) join {_FACTS['years']} using (job_id) join {_FACTS['arrangement']} using (job_id) join {_FACTS['skills']} using (job_id)""",
    "diagnostic_postings": f"""with {RAW}, g0 as (select {S.gold_text()['job_id']} job_id, lower({S.gold_text()['work_arrangement']}) g from orders), m as (select * from raw join g0 using (job_id) where g in ('hybrid', 'unclear')),
 c as (select job_id, 1 k from m where g = 'hybrid' and regexp_matches(description, '(?i)\\bhybrid\\b') qualify row_number() over (order by job_id) = 1 union all select job_id, 2 from m where g = 'unclear' and regexp_matches(description, '(?i)onsite|on-site|remote|hybrid') qualify row_number() over (order by job_id) = 1 union all select min(job_id), 3 + min(job_id) from m group by g)
 select job_id, title from raw where job_id in (select job_id from (select job_id, min(k) k from c group by 1) order by k limit 2)""",
    "prompt_costs": f"""with {RAW}, v as (select * from (values {', '.join(f"('{v}', {n})" for v, n in _EDGES.items())}) v(variant, edge)), p as (select variant, length(coalesce(title, '')) + length(coalesce(description, '')) + edge n from raw, v),
 s as (select variant, count(*) calls, sum(n / 4) input_tokens, count(*) * {D.OUTPUT_TOKENS} output_tokens from p group by rollup (variant)) select coalesce(variant, 'all') variant, calls, input_tokens, output_tokens, round(input_tokens / 1e6 * {C.COST_IN} + output_tokens / 1e6 * {C.COST_OUT}, 6) cost_usd from s""",
    "error_counts": f"with {_ITEMS}, e as (select method, count(*) postings, " + ", ".join(f"count(case when not {c} then 1 end) {n}_errors" for n, c in C.ERRORS.items()) + f" from it group by 1) select *, cast(row_number() over (order by coalesce(nullif(list_position({_CASE(C.METHOD_ORDER)}, method), 0), 99), method) as int) place, " + ", ".join(f"round({n}_errors / postings::double, 6) {n}_error_rate" for n in C.ERRORS) + " from e",
    "metric_ties": f"with {_LONG}, r as (select *, rank() over (partition by metric order by if(metric in ('years_mae_answered', 'years_false_positive_rate'), value, -value)) k from lo where value is not null) select metric, any_value(value) as value, string_agg(method, ',' order by method) methods, cast(count(*) as int) n_tied from r where k = 1 group by 1",
    "evidence_consistency": f"with {_PREDICTED}, q as (select p.*, o_custkey % 3 = 1 quoted from pred p join orders on o_orderkey = job_id) select method, count(case when quoted then 1 end) quoted, count(case when quoted and salary_min is null then 1 end) value_null, round(100.0::double * count(case when quoted and salary_min is null then 1 end) / greatest(count(case when quoted then 1 end), 1), 1) inconsistency_pct from q group by 1",
    "model_costs": f"with {_PREDICTED} select method, count(*) predictions, round(sum(if(cached, 0, cost_usd)), 6) recorded_run_cost_usd, round(sum(cost_usd), 6) estimated_model_cost_usd, round(1000 * avg(cost_usd), 3) estimated_cost_per_1k from pred where method <> 'rules' group by 1",
    "best_variant_tests": f"""with {_drawn({m: (m, f'case when {m} is not null then 1 end') for m in ('salary', 'seniority')}, _BEST, '(select method from best)')}, dc as (select o.metric, o.method, count(case when o.num > r.num then 1 end) a, count(case when o.num < r.num then 1 end) b from ce o join ce r using (job_id, metric) where r.method = (select method from best) and o.method <> r.method group by 1, 2)
 select bo.*, {_R6("case when a + b = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(a, b) + 1), lambda i: exp(lgamma(a + b + 1.0) - lgamma(i + 1.0) - lgamma(a + b - i + 1.0) - (a + b) * ln(2.0))))) end")} p_raw, (select method from best) best from bo join dc using (metric, method)""",
    "top_extra_skills": f"with {_ITEMS}, x as (select method, unnest(list_filter(fa, lambda x: not list_contains(a, x))) skill from b), n as (select method, skill, count(*) extra from x group by all) select *, cast(row_number() over (partition by method order by extra desc, skill) as int) as rank from n qualify rank <= 12",
    "benchmark_composition": f"with {RAW}, {BASE}, {_BENCH} select stratum, pay_bucket, count(*) n, round(count(*) / (select count(*)::double from bench), 6) share from bench group by all",
    "role_skills_ranked": f"select role_family, skill_name, postings, cast(row_number() over (order by role_family <> 'All data roles', role_family, postings desc, display_order) as int) place from ({MARKET_SQL['role_skills']})",
    "salary_error_quantiles": f"with {_SCORED} select method, round(quantile_cont(salary_pct_error, 0.5), 4) median_error, round(quantile_cont(salary_pct_error, 0.9), 4) p90_error from sc where stratum = 'labeled_stated' and salary_pct_error is not null group by 1",
    "titles_like": f"with {RAW}, " + f"p as (select unnest({_CASE(LIKE)}) pattern) select pattern, count(*) n from raw join p on title like pattern escape '\\' group by 1",
}
