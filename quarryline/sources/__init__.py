"""Tables: readers of the star schema, and the posting tables that stand over it.

The raw tables (postings, companies, mappings, extractions) are given as column texts that Spark and the SQL of the
tests both read, so that the two start from the same rows and differ in everything after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .seeds import ARRANGEMENTS, PAYS, SKILL_TEXTS, TITLES, YEARS

#: Neutral words between the parts of a made-up description, wider than any window of the extractors.
FILL = " " + "and so on " * 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of a file whose rows are one task's row-wise work.
TASK_BYTES = 1 << 19


def spread(scan: DataFrame, key: str | None = None) -> DataFrame:
    """A scan for row-wise work that is dear. By ``key`` (distinct, so that no task gets more than others) it is dealt out,
    columns as they lie in the file, to tasks of so many bytes, whatever the file's row groups: splits follow bytes,
    but a row group is one split's, and rows of a few bytes can be dear. What is joined by that key later lies right
    already. Without a key, a scan of fewer splits than there are cores is dealt out; any other stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if key is not None:
        size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return scan.repartition(max(cores, size // TASK_BYTES + 1), key)
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def choice(key: str, texts: list[str]) -> str:
    """A CASE that deals the texts (SQL expressions) out by a whole number."""
    return f"(case {key} % {len(texts)} " + " ".join(f"when {i} then {t}" for i, t in enumerate(texts)) + " end)"


def quoted(texts) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


#: Parts of a description by order key; each is dealt out by another modulus.
PARTS = {"pay": (lambda k: choice(k, [p[0] for p in PAYS])), "skills": (lambda k: choice(f"({k} + 3)", quoted(s[0] for s in SKILL_TEXTS))), "arrangement": (lambda k: choice(f"({k} + 5)", quoted(a[0] for a in ARRANGEMENTS))), "years": (lambda k: choice(f"({k} + 7)", quoted(y[0] for y in YEARS)))}
_DESCRIPTION = " || ".join(["'We look for a colleague.'", *(f"'{FILL}' || {make('o_orderkey')}" for make in PARTS.values())])

#: Raw postings over orders. ``{days}`` is the engine's count of days since 1970 of the order's date.
POSTINGS = {
    "job_id": "o_orderkey",
    "company_id": "case when o_orderkey % 17 = 0 then 'none' when o_orderkey % 11 = 0 then o_custkey || '.0' when o_orderkey % 13 = 0 then o_custkey || '.6' else '' || o_custkey end",
    "company_name": "case when o_orderkey % 11 = 0 then null else 'Employer ' || (o_custkey % 400) end",
    "title": choice("o_orderkey", quoted(t[0] for t in TITLES)),
    "description": f"case when o_orderkey % 31 = 0 then null when o_orderkey % 29 = 0 then 'Apply now.' else {_DESCRIPTION} end",
    "location": "'City ' || (o_orderkey % 50)",
    "original_listed_time": "{days} * 86400000 + (o_orderkey % 86400) * 1000",
    "formatted_work_type": "case o_orderkey % 3 when 0 then 'Full-time' when 1 then 'Contract' else 'Part-time' end",
    "formatted_experience_level": "case when o_orderkey % 4 = 0 then null else " + choice("o_orderkey", ["'Mid-Senior level'", "'Entry level'", "'Executive'", "'Internship'", "'Director'"]) + " end",
    "remote_allowed": "case when o_orderkey % 8 = 0 then 1 end",
    "sponsored": "case when o_orderkey % 3 = 0 then 1 else 0 end",
    "views": "case when o_orderkey % 7 <> 0 then o_orderkey % 101 end",
    "applies": "case when o_orderkey % 6 <> 0 then o_orderkey % 41 end",
    "currency": "case o_orderkey % 10 when 0 then null when 1 then 'EUR' else 'USD' end",
    "pay_period": "case o_orderkey % 6 when 0 then 'YEARLY' when 1 then 'HOURLY' when 2 then 'MONTHLY' when 3 then 'WEEKLY' when 4 then 'BIWEEKLY' end",
    "min_salary": "case when o_orderkey % 5 < 3 then o_totalprice end",
    "med_salary": "case when o_orderkey % 5 = 3 then o_totalprice end",
    "max_salary": "case when o_orderkey % 5 < 3 then o_totalprice * 2 end",
    "normalized_salary": "case when o_orderkey % 5 <> 0 then o_totalprice end",
}
SPARK_DAYS = "cast(datediff(to_date(o_orderdate), date'1970-01-01') as bigint)"


def raw_postings(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """Orders seen as postings, with all columns as the source gives them. ``texts``: their long texts will be read."""
    orders = table(spark, sf_dir, "orders")
    return (spread(orders, "o_orderkey") if texts else orders).selectExpr(*(f"{text.replace('{days}', SPARK_DAYS)} as {name}" for name, text in POSTINGS.items()))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
        .select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("company_size"), F.concat(F.lit("City "), F.col("c_custkey") % 50).alias("city"), F.col("n_name").alias("state"), F.col("r_name").alias("country"))
    )


def job_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (job, industry, name): the nations of an order's suppliers; some have no name."""
    l, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    names = n.where("n_nationkey % 13 <> 0").select(F.col("n_nationkey").alias("industry_id"), F.col("n_name").alias("industry_name"))
    pairs = l.join(s, l.l_suppkey == s.s_suppkey).select(F.col("l_orderkey").alias("job_id"), F.col("s_nationkey").alias("industry_id")).distinct()
    return pairs.join(F.broadcast(names), "industry_id", "left")  # 25 rows by definition


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (job, skill, name): the brands of an order's parts; one has no name."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    pairs = l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("job_id"), F.col("p_brand").alias("skill_abr")).distinct()
    return pairs.withColumn("skill_name", F.when(F.col("skill_abr") != "Brand#7", F.concat(F.lit("Function "), "skill_abr")))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as predictions: one per (item, method), the latest."""
    e = table(spark, sf_dir, "events")
    latest = e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "props"), F.struct("ts", "event_id")).alias("x"))
    return latest.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("method"), F.col("x.value").alias("value"), F.get_json_object("x.props", "$.k").cast("int").alias("k"))


#: Raw predictions of each method over orders: how far a method is off, when it is silent, what it costs.
METHODS = {"rules": 3, "zero_shot": 4, "few_shot": 5, "schema_rules": 7}


def predictions_text(method: str, m: int) -> dict[str, str]:
    llm = method != "rules"
    return {
        "job_id": "o_orderkey",
        "method": f"'{method}'",
        "salary_min": f"case when o_orderkey % {m} = 0 then null when o_orderkey % {m} = 1 then o_totalprice * 1.3 else o_totalprice end",
        "salary_max": "o_totalprice * 2",
        "pay_period": f"case when o_orderkey % {m + 6} = 0 then null when o_orderkey % {m + 4} = 0 then 'HOURLY' else case o_orderkey % 6 when 0 then 'YEARLY' when 1 then 'HOURLY' when 2 then 'MONTHLY' when 3 then 'WEEKLY' when 4 then 'BIWEEKLY' end end",
        "seniority": f"case when o_orderkey % {m} = 2 then null when o_orderkey % {m + 2} = 0 then 'Director' else " + choice("o_orderkey", ["'Mid-Senior level'", "'Entry level'", "'Executive'", "'Internship'", "'Director'"]) + " end",
        "valid_json": f"o_orderkey % {m * 10} <> 0" if llm else "true",
        "input_tokens": f"1000 + o_orderkey % {m * 100}" if llm else "0",
        "output_tokens": f"100 + o_orderkey % {m * 10}" if llm else "0",
        "latency_s": f"1.5 + (o_orderkey % {m * 10}) / 8.0e0" if llm else "0.0e0",
        "cached": f"o_orderkey % {m} = 0" if llm else "false",
    }


#: What the models were asked for: a tenth of the postings (the rules ran on all).
ASKED = "o_orderkey % 10 < 3"


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions of all methods in one shape: one scan, each row dealt to every method."""
    o = table(spark, sf_dir, "orders")
    rows = [f"case when {ASKED if method != 'rules' else 'true'} then named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, {cast(c, t)}' for c, t in predictions_text(method, m).items())}) end" for method, m in METHODS.items()]
    return o.select(F.expr(f"inline(filter(array({', '.join(rows)}), x -> x is not null))"))


def cast(column: str, text: str) -> str:
    kind = {"salary_min": "double", "salary_max": "double", "input_tokens": "bigint", "output_tokens": "bigint", "latency_s": "double"}.get(column)
    return f"cast({text} as {kind})" if kind else text


#: What annotators and methods say about each posting, as lists in a text; a method is off by another shift.
GOLD_REQUIRED, GOLD_PREFERRED = ["sql, python", "excel", "", "tableau, sql, dbt"], ["aws", "", "spark, kafka"]
FOUND_PREFERRED = ["aws, sql", "", "spark"]
WORK, YEARS_SAID = ["Remote", "Hybrid", "Onsite", "Unclear"], ["3", "null", "5", "1", "10"]


def gold_text() -> dict[str, str]:
    return {"job_id": "o_orderkey", "required_skills": choice("o_orderkey", quoted(GOLD_REQUIRED)), "preferred_skills": choice("o_orderkey", quoted(GOLD_PREFERRED)), "work_arrangement": choice("o_orderkey", quoted(WORK)), "years_experience_min": f"cast({choice('o_orderkey', YEARS_SAID)} as double)"}


def found_text(method: str, m: int | str) -> dict[str, str]:
    """``m``: the method's number, or a column of it (then ``method`` is one, too)."""
    off = f"(o_orderkey + case when o_orderkey % {m} = 0 then 1 else 0 end)"
    silent, name = (m + 7, f"'{method}'") if isinstance(m, int) else (f"({m} + 7)", method)
    return {"job_id": "o_orderkey", "method": name, "required_skills": choice(off, quoted(GOLD_REQUIRED)), "preferred_skills": choice(off, quoted(FOUND_PREFERRED)), "work_arrangement": f"case when o_orderkey % {silent} <> 0 then {choice(off, quoted(WORK))} end", "years_experience_min": f"cast({choice(off, YEARS_SAID)} as double)"}


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").selectExpr(*(f"{t} as {c}" for c, t in gold_text().items()))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan, each row dealt to every method; its key stays beside, so the rows still lie by it. Columns are made after the dealing:
    inside it the code of all methods' columns is one that the JVM doesn't compile, and columns that nobody asks for are made."""
    methods = ", ".join(f"named_struct('method', '{method}', 'm', {m})" for method, m in METHODS.items())
    dealt = spread(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", F.expr(f"inline(array({methods}))"))
    return dealt.selectExpr(*(f"{t} as {c}" for c, t in found_text("method", "m").items()))
