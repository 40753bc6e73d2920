"""Dataset builders: the typed base view, stratified benchmark and holdout, gold sample, pinned and proportional samples.

Pseudo-random orders are those of an MD5 digest of seed and key: the same on every engine and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .market import family, listed
from .patterns import begun, holds, needed, occurring

LEAST_CHARS, GOLD_CHARS = 500, 800
# Rows of each cell of the benchmark, and of each family of the gold sample.
QUOTAS = {("labeled_stated", "YEARLY"): 800, ("labeled_stated", "HOURLY"): 700, ("labeled_stated", "OTHER"): 100, ("labeled_not_stated", "YEARLY"): 200, ("labeled_not_stated", "HOURLY"): 150, ("labeled_not_stated", "OTHER"): 50}
GOLD_QUOTAS = {"Data Analyst": 20, "Business Analyst": 16, "Data Engineer": 14, "Data Scientist": 12, "BI Analyst": 10, "Analytics Engineer": 4, "Product Analyst": 4}
LEAST_SKILLS = 2


def shuffled(key: str = "job_id", seed: str = "42") -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def base(raw: DataFrame, least_chars: int = LEAST_CHARS, also: tuple[Column, ...] = ()) -> DataFrame:
    """Postings with a description worth reading, the flags that all later steps share, and what else is asked for."""
    # coalesce: a made-up description is made once for this filter, not again to tell whether it is null
    kept = raw.where(F.coalesce(F.length("description"), F.lit(-1)) >= least_chars)
    return kept.select(
        "job_id", "company_name", "title", "description", "location", "min_salary", "med_salary", "max_salary", "normalized_salary", "pay_period", "currency",
        F.col("formatted_work_type").alias("work_type"), F.col("formatted_experience_level").alias("exp_level"), "remote_allowed", listed().alias("listed_date"), F.length("description").alias("desc_len"),
        (F.col("min_salary").isNotNull() | F.col("med_salary").isNotNull()).alias("has_salary_label"), F.col("description").rlike(r"\$\s?[0-9]").alias("salary_in_text"), family().alias("role_family"), *also,
    )


def quota(keys: list[str], quotas: dict, rest: int = 0) -> Column:
    out = F.lit(rest)
    for values, n in quotas.items():
        same = F.lit(True)
        for k, v in zip(keys, values if isinstance(values, tuple) else (values,), strict=True):
            same = same & (F.col(k) == v)
        out = F.when(same, n).otherwise(out)
    return out


def stratified(rows: DataFrame, keys: list[str], quotas: dict, pinned: list[int] | None = None) -> DataFrame:
    """The first rows of each stratum up to its quota: pinned ones, then in shuffled order. The rank is a window
    limit by the largest quota, so each map task keeps no more than that a stratum before the shuffle."""
    first = F.col("job_id").isin(pinned or []).cast("int")
    by = Window.partitionBy(*keys).orderBy(F.desc(first), shuffled(), "job_id")
    return rows.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= max(quotas.values())).where(F.col("rn") <= quota(keys, quotas)).drop("rn")


def strata(rows: DataFrame) -> DataFrame:
    return rows.where("has_salary_label").withColumns({"stratum": F.when(F.col("salary_in_text"), "labeled_stated").otherwise("labeled_not_stated"), "pay_bucket": F.when(F.col("pay_period").isin("YEARLY", "HOURLY"), F.col("pay_period")).otherwise("OTHER")})


def benchmark(base_rows: DataFrame, quotas: dict = QUOTAS, pinned: list[int] | None = None) -> DataFrame:
    return stratified(strata(base_rows), ["stratum", "pay_bucket"], quotas, pinned)


def not_in(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """NOT IN: rows whose key is in none of the others; a null key is kept only against nothing, and a null
    among the others keeps nothing."""
    state = taken.agg(F.count("*").alias("_rows"), F.count(key).alias("_keys"))  # one row
    left = df.join(taken.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return left.join(F.broadcast(state)).where((F.col("_rows") == 0) | (F.col(key).isNotNull() & (F.col("_rows") == F.col("_keys")))).drop("_rows", "_keys")


def holdout(base_rows: DataFrame, used: DataFrame, quotas: dict = QUOTAS) -> DataFrame:
    return benchmark(not_in(base_rows, used, "job_id"), quotas)


def pinned_sample(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("job_id").distinct(), "job_id", "left_semi").orderBy("job_id")


def proportional(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """About ``limit`` rows in proportion to the strata, one of each at least, in shuffled order."""
    cells = rows.groupBy(*keys).agg(F.count("*").alias("cell_n"))
    total = cells.agg(F.sum("cell_n").alias("total_n"))
    want = cells.join(F.broadcast(total)).select(*keys, F.greatest(F.lit(1), F.round(F.lit(float(limit)) * F.col("cell_n") / F.col("total_n")).cast("int")).alias("_want"))
    by = Window.partitionBy(*keys).orderBy(shuffled(), "job_id")
    ranked = rows.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= limit)  # no cell wants more
    return ranked.join(F.broadcast(want), keys).where("rn <= _want").drop("rn", "_want")  # a row a stratum


def shrinkage(pattern: str, of: Column) -> Column:
    """How many characters go when the pattern is taken out."""
    return F.length(of) - F.length(F.regexp_replace(of, pattern, ""))


TOOLS = [r"\bsql\b", r"\bpython\b", r"\bexcel\b", r"\btableau\b", r"power\s?-?bi|powerbi", r"\blooker\b", r"\bsnowflake\b", r"\bdbt\b", r"\bairflow\b", r"\bspark\b", r"\baws\b", r"\bazure\b"]
HARD, SOFT = "required|must have|essential", "preferred|a plus|nice to have|desirable|bonus"
A_YEAR, PLACES = r"[0-9]+\+?\s*(year|yr)", [r"\bremote\b", r"\bhybrid\b", "on-?site|in-?office"]
STACK = "our (stack|tech|technology)|we use|built (on|with)|our platform"
#: Of each pattern strings of which the lower-cased text of a match holds one.
_NEEDED = {p: needed(p) for p in [*TOOLS, HARD, SOFT, *PLACES, STACK]} | {A_YEAR: ["year", "yr"]}
_LITERALS = sorted({x for some in _NEEDED.values() for x in some})


def difficulty(roles: DataFrame) -> DataFrame:
    """Signals that make a posting hard to label, and their weighted sum. A pattern is searched for only where a string that
    it needs is; all of these strings are looked for at once."""
    low, text = F.col("_low"), F.col("description")
    may = lambda p: holds(F.col("_held"), _LITERALS, _NEEDED[p])
    has = lambda p: (may(p) & low.rlike(begun(p))).cast("int")
    signals = {
        "n_skills": sum((has(s) for s in TOOLS), F.lit(0)),
        "has_both_hedges": has(HARD) * has(SOFT),
        "year_mention_density": F.least(F.lit(3), F.when(~may(A_YEAR), 0).otherwise(shrinkage(A_YEAR, low))),
        "n_arrangement_words": sum((has(p) for p in PLACES), F.lit(0)),
        "n_dollar_figures": F.least(F.lit(3.0), F.when(~text.contains("$"), 0).otherwise(shrinkage(r"\$\s?[0-9]", text)) / 2),
        "has_company_stack_language": has(STACK),
    }
    total = "3 * has_both_hedges + 2 * year_mention_density + 2 * n_arrangement_words + n_dollar_figures + 2 * has_company_stack_language + least(2.0, n_skills / 3)"
    known = roles.withColumn("_low", F.lower("description")).withColumn("_held", occurring(_LITERALS)(low))
    return known.withColumns(signals).drop("_low", "_held").withColumn("difficulty", F.expr(total))


def gold_sample(roles: DataFrame, quotas: dict = GOLD_QUOTAS, least_skills: int = LEAST_SKILLS) -> DataFrame:
    """The hardest postings of each family, one of each distinct description, up to the family's quota."""
    scored = difficulty(roles).where(F.col("n_skills") >= least_skills)
    one = scored.groupBy(F.md5("description").alias("_digest")).agg(F.min_by(F.struct(*scored.columns), "job_id").alias("x")).select("x.*")
    by = Window.partitionBy("role_family").orderBy(F.desc("difficulty"), shuffled(), "job_id")
    return one.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= max(quotas.values())).where(F.col("rn") <= quota(["role_family"], quotas)).drop("rn")


def diagnostic_rows(postings: DataFrame, gold: DataFrame) -> DataFrame:
    """Two postings to try a model on: one that is hybrid and says so, and one that is unclear although it speaks of
    arrangements; where one is missing, the first of the labels hybrid and unclear. The first by job_id each; the job fails
    unless there are two."""
    met = postings.join(gold.select("job_id", F.lower("work_arrangement").alias("_gold")).hint("merge"), "job_id").where("_gold in ('hybrid', 'unclear')")
    low, first = F.lower("description"), lambda ok: F.min(F.when(ok, F.col("job_id")))
    hybrid, unclear = F.col("_gold") == "hybrid", F.col("_gold") == "unclear"
    rest = F.array_sort(F.array_compact(F.array(first(hybrid), first(unclear))))
    chosen = met.agg(F.slice(F.array_distinct(F.concat(F.array_compact(F.array(first(hybrid & low.rlike(r"\bhybrid\b")), first(unclear & low.rlike("onsite|on-site|remote|hybrid")))), rest)), 1, 2).alias("ids"))
    two = chosen.where(F.when(F.size("ids") == 2, True).otherwise(F.raise_error(F.lit("there are no two diagnostic postings")).cast("boolean")))
    return postings.join(F.broadcast(two.select(F.explode("ids").alias("job_id"))), "job_id")  # two rows


def composition(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a sample is made of: rows of each key's values, and their share."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return sums.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # a row a group


#: Output tokens of a call, and characters of a token, for estimates.
OUTPUT_TOKENS, CHARS_A_TOKEN = 250, 4


def prompts(postings: DataFrame, templates: dict[str, str], variants: list[str] | None = None) -> DataFrame:
    """Every posting with every variant's prompt: ``job_id, variant, prompt``. A template holds ``{title}`` and ``{description}`` once
    each, in this order; an unknown variant is an error."""
    wanted = list(templates) if variants is None else variants
    if unknown := sorted(set(wanted) - set(templates)):
        raise ValueError(f"unknown variants {unknown}; there are {sorted(templates)}")

    def filled(template: str) -> Column:
        head, _, rest = template.partition("{title}")
        middle, _, tail = rest.partition("{description}")
        return F.concat(F.lit(head), F.coalesce("title", F.lit("")), F.lit(middle), F.coalesce("description", F.lit("")), F.lit(tail))

    each = F.array(*(F.struct(F.lit(v).alias("variant"), filled(templates[v]).alias("prompt")) for v in wanted))
    return postings.select("job_id", F.inline(each))


def dry_run(asked: DataFrame, cost_in: float, cost_out: float) -> DataFrame:
    """What the prompts would cost, by variant and over all (null variant)."""
    tokens, out = F.sum(F.length("prompt") / CHARS_A_TOKEN), F.count("*") * OUTPUT_TOKENS
    sums = asked.rollup("variant").agg(F.count("*").alias("calls"), tokens.alias("input_tokens"), out.alias("output_tokens"))
    return sums.withColumn("cost_usd", F.round(F.col("input_tokens") / 1e6 * cost_in + F.col("output_tokens") / 1e6 * cost_out, 6))
