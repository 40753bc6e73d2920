"""Market marts over postings: staging, facts, aggregates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import beside, cells_of, in_cells, let, pct, quantiles_of, rounded, valid_salary, valued, with_quantiles
from ..sources.seeds import ROLE_FAMILIES, SKILL_PATTERNS
from .patterns import holds, occurring

MEDIAN = {"median_salary_usd": 0.5}
QUARTILES = {"median_salary_usd": 0.5, "salary_p25_usd": 0.25, "salary_p75_usd": 0.75}
REMOTE = "remote_status = 'Remote tagged'"


def _period(date: Column, part: str) -> Column:
    return F.trunc(date, part)


def listed(ms: str = "original_listed_time") -> Column:
    """The day (UTC) of a time in milliseconds, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ms) / 86_400_000).cast("int"))


def remote_status() -> Column:
    """Only tagged postings are known to be remote; null is unknown, not onsite."""
    return F.when(F.col("remote_allowed") == 1, "Remote tagged").otherwise("Unknown / not supplied")


def whole_id(name: str) -> Column:
    """A text as a whole number, as an engine reads one that rounds: '2774458.0' is 2774458, what is no number is null."""
    return F.round(F.col(name).try_cast("decimal(38,10)")).try_cast("bigint")


def staged_postings(raw: DataFrame) -> DataFrame:
    date = listed()
    salary = valid_salary()
    return raw.select(
        "job_id", whole_id("company_id").alias("company_id"), "company_name", "title", "location",
        date.alias("posting_date"), _period(date, "week").alias("posting_week"), _period(date, "month").alias("posting_month"),
        F.col("formatted_work_type").alias("employment_type"), F.col("formatted_experience_level").alias("experience_level"),
        remote_status().alias("remote_status"), (F.col("sponsored") == 1).alias("is_sponsored"), "views", "applies",
        "currency", "pay_period", "min_salary", "med_salary", "max_salary", "normalized_salary",
        salary.alias("annualized_salary_usd"), salary.isNotNull().alias("has_valid_salary"),
    )


def fact_postings(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings with their company; a posting's own name of it comes first."""
    c = companies.select("company_id", F.col("company_name").alias("_name"), "company_size", F.col("city").alias("company_city"), F.col("state").alias("company_state"), F.col("country").alias("company_country"))
    return postings.join(c, "company_id", "left").withColumn("company_name", F.coalesce("company_name", "_name", F.lit("Unknown company"))).drop("_name")


def _engagement() -> list[Column]:
    return [rounded(F.avg("views"), 1).alias("average_views"), rounded(F.avg("applies"), 1).alias("average_applies")]


def _coverage() -> list[Column]:
    n = F.count("*")
    return [F.count_if("has_valid_salary").alias("salary_postings"), pct(F.count_if("has_valid_salary"), n).alias("salary_coverage_pct"), F.count_if(F.expr(REMOTE)).alias("remote_tagged_postings"), pct(F.count_if(F.expr(REMOTE)), n).alias("remote_tagged_pct")]


def overview(facts: DataFrame) -> DataFrame:
    sums = facts.agg(
        F.count("*").alias("total_postings"), F.count_distinct("company_id").alias("companies_with_id"), F.count_distinct("company_name").alias("company_names"), F.min("posting_date").alias("earliest_posting_date"), F.max("posting_date").alias("latest_posting_date"),
        *_coverage(), F.count_if("is_sponsored").alias("sponsored_postings"), *_engagement(),
    ).withColumnRenamed("salary_postings", "valid_salary_postings")
    return with_quantiles(sums, facts, [], "annualized_salary_usd", QUARTILES)


def calendar(days: DataFrame) -> DataFrame:
    """Every day from the first to the last of an already aggregated table."""
    return days.agg(F.min("posting_date").alias("a"), F.max("posting_date").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("posting_date"))


def daily(facts: DataFrame) -> DataFrame:
    """One row a day, empty ones too, with the mean of the last seven. After aggregation the rows are as many as
    days, so the window over all of them is small at any scale."""
    sums = facts.groupBy("posting_date").agg(F.count("*").alias("postings"), F.count_distinct("company_id").alias("companies"), F.count_if("has_valid_salary").alias("salary_postings"), F.count_if(F.expr(REMOTE)).alias("remote_tagged_postings"), F.count_if("is_sponsored").alias("sponsored_postings"))
    counts = ["postings", "companies", "salary_postings", "remote_tagged_postings", "sponsored_postings"]
    whole = calendar(sums).join(with_quantiles(sums, facts, ["posting_date"], "annualized_salary_usd", MEDIAN), "posting_date", "left").na.fill(0, counts)
    share = lambda c: F.coalesce(pct(F.col(c), F.col("postings")), F.lit(0.0))
    week = Window.orderBy("posting_date").rowsBetween(-6, 0)
    return whole.withColumns({"salary_coverage_pct": share("salary_postings"), "remote_tagged_pct": share("remote_tagged_postings"), "postings_7d_average": rounded(F.avg("postings").over(week), 2)})


def by_company(facts: DataFrame) -> DataFrame:
    keys = ["company_id", "company_name", "company_size", "company_city", "company_state", "company_country"]
    known = facts.where("company_id is not null")
    return with_quantiles(known.groupBy(*keys).agg(F.count("*").alias("postings"), *_coverage(), *_engagement()), known, keys, "annualized_salary_usd", MEDIAN)


def by_code(facts: DataFrame, codes: DataFrame, keys: list[str], remote: bool) -> DataFrame:
    """Many-to-many breakdown by code and name (unnamed codes left out): counts, share of all postings, median.
    ``codes`` has distinct rows a job."""
    slim = facts.select("job_id", "has_valid_salary", "annualized_salary_usd", "remote_status")
    total = slim.agg(F.count("*").alias("_all"))  # one row
    met = slim.join(codes.where(F.col(keys[1]).isNotNull()), "job_id")
    sums = met.groupBy(*keys).agg(F.count("*").alias("postings"), F.count_if("has_valid_salary").alias("salary_postings"), *([F.count_if(F.expr(REMOTE)).alias("remote_tagged_postings")] if remote else []))
    shared = sums.join(F.broadcast(total)).withColumn("market_share_pct", pct(F.col("postings"), F.col("_all"))).drop("_all")
    return with_quantiles(shared, met, keys, "annualized_salary_usd", MEDIAN)


def family(title: str = "title") -> Column:
    """Ordered taxonomy: the first rule that matches names the role family; null if none."""
    t = F.lower(F.col(title))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ROLE_FAMILIES):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


def data_roles(base: DataFrame) -> DataFrame:
    """Postings of the data families with the staged measures, in one pass (``base``: datasets.base with ``whole_id("company_id")``)."""
    salary = valid_salary()
    return base.where("role_family is not null").select(
        "job_id", "company_id", "company_name", "title", "description", "location", "role_family", F.col("listed_date").alias("posting_date"), _period(F.col("listed_date"), "week").alias("posting_week"), _period(F.col("listed_date"), "month").alias("posting_month"),
        F.col("work_type").alias("employment_type"), F.col("exp_level").alias("experience_level"), remote_status().alias("remote_status"),
        salary.alias("annualized_salary_usd"), salary.isNotNull().alias("has_valid_salary"),
    )


def by_family(roles: DataFrame) -> DataFrame:
    sums = roles.groupBy("role_family").agg(F.count("*").alias("postings"), F.count_distinct("company_id").alias("companies"), F.min("posting_date").alias("earliest_posting_date"), F.max("posting_date").alias("latest_posting_date"), *_coverage())
    return with_quantiles(sums, roles, ["role_family"], "annualized_salary_usd", QUARTILES)


def family_daily(roles: DataFrame) -> DataFrame:
    """The complete grid of days and families that occur, from one aggregation."""
    keys = ["posting_date", "role_family"]
    cells = cells_of(roles, [*keys, "remote_status"], "annualized_salary_usd")
    sums = cells.groupBy(*keys).agg(F.sum("_n").alias("postings"), in_cells(F.col("_v").isNotNull()).alias("salary_postings"), in_cells(F.expr(REMOTE)).alias("remote_tagged_postings"))
    occur = sums.where("postings > 0")  # all do, but without their numbers these would be cells of another plan
    grid = calendar(occur).join(F.broadcast(occur.select("role_family").distinct()))  # families: a handful, by the taxonomy
    return beside(grid, beside(sums, quantiles_of(valued(cells), keys, MEDIAN), keys), keys).na.fill(0, ["postings", "salary_postings", "remote_tagged_postings"])


_WORD = re.compile(r"\(\^\|\[\^a-z0-9\]\)(\w+)\(\[\^a-z0-9\]\|\$\)")


def _needed(pattern: str) -> list[str]:
    """Of each alternative of a seed pattern a text that it can't do without."""
    plain = _WORD.sub(r"\1", pattern.removeprefix("(?i)")).strip("()")
    return sorted({max(re.findall("[a-z0-9 -]+", a), key=len) for a in plain.split("|")})


def _alone(word: str) -> str:
    """A pattern of a word between characters that are no letters or digits. It begins with the word itself, so that a search
    goes from one place of it to the next instead of trying every place for a boundary."""
    return f"{word}(?![a-z0-9])(?<![a-z0-9]{word})"


#: Of each seed pattern the word that it is, if it is one, and the strings of which its matches hold one.
_SINGLE = {p: m.group(1) for _, _, p, _ in SKILL_PATTERNS if (m := _WORD.fullmatch(p.removeprefix("(?i)")))}
_PARTS = {p: [_SINGLE[p]] if p in _SINGLE else _needed(p) for _, _, p, _ in SKILL_PATTERNS}
_LITERALS = sorted({x for some in _PARTS.values() for x in some})


def _mentions(low: Column, held: Column) -> Column:
    """The patterns that occur in a lower-cased text, each searched for only where a string that it needs is."""

    def found(x: Column) -> Column:
        out = []
        for name, category, pattern, order in SKILL_PATTERNS:
            hit = holds(x["held"], _LITERALS, _PARTS[pattern]) & x["low"].rlike(_alone(_SINGLE[pattern]) if pattern in _SINGLE else pattern)
            out.append(F.when(hit, F.struct(F.lit(name).alias("skill_name"), F.lit(category).alias("skill_category"), F.lit(order).alias("display_order"))))
        return F.array_compact(F.array(*out))

    return let(F.struct(low.alias("low"), held.alias("held")), found)


def skill_mentions(roles: DataFrame) -> DataFrame:
    """One row a job and technology that its description names (none of a null one). No join: the patterns are part of the plan."""
    kept = ["job_id", "role_family", "posting_date", "company_id", "company_name", "location", "experience_level", "remote_status", "annualized_salary_usd", "has_valid_salary"]
    low = roles.select(*kept, F.lower("description").alias("_low"))
    return low.withColumn("_held", occurring(_LITERALS)(F.col("_low"))).select(*kept, F.inline(_mentions(F.col("_low"), F.col("_held"))))


def role_skills(roles: DataFrame, mentions: DataFrame, every: str = "All data roles") -> DataFrame:
    """Postings that name each technology, by family and over all, with their share and median salary."""
    both = F.explode(F.array("role_family", F.lit(every)))
    sizes = roles.select(both.alias("role_family")).groupBy("role_family").agg(F.count("*").alias("_all"))
    named, keys = ["skill_name", "skill_category", "display_order"], ["skill_name", "skill_category", "display_order", "role_family"]
    cells = cells_of(mentions, keys, "annualized_salary_usd").select(*named, both.alias("role_family"), "_v", "_n")
    sums = cells.groupBy(*keys).agg(F.sum("_n").alias("postings"), in_cells(F.col("_v").isNotNull()).alias("salary_postings"))
    shared = sums.join(F.broadcast(sizes), "role_family").withColumn("role_share_pct", pct(F.col("postings"), F.col("_all"))).drop("_all")  # a row a family
    return beside(shared, quantiles_of(valued(cells), keys, MEDIAN), keys)


def ranked_skills(skills: DataFrame, every: str = "All data roles") -> DataFrame:
    """The order in which role skills are shown: all roles first, then families by name, the most named first (rows: a
    technology and family each)."""
    order = Window.orderBy(F.when(F.col("role_family") == every, 0).otherwise(1), "role_family", F.desc("postings"), "display_order")
    return skills.select("role_family", "skill_name", "postings", F.row_number().over(order).alias("place"))
