"""Extractors and normalisers as queries. Their SQL doesn't repeat the patterns: the descriptions are made from parts,
and the SQL states what a right extractor finds in each part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources as S
from ..operators import extract as E
from ..operators import normalise as N
from ..sources.seeds import ARRANGEMENTS, PAYS, SKILL_TEXTS, TITLES, YEARS


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.raw_postings(spark, sf_dir, True).select("job_id", "title", "description")


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractors over whole documents; the source stands in for a title."""
    d = S.spread(S.table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("job_id"), F.col("source").alias("title"), "text")
    f = E.facts(d)
    return f.select("job_id", "salary.low", "salary.high", "salary.period", F.col("seniority.level").alias("seniority"), F.col("years.least").alias("years_min"), "arrangement.arrangement", F.array_join("skills.required", ",").alias("required"), F.array_join("skills.preferred", ",").alias("preferred"))


def _one(column: Callable, *fields: str):
    names = [f.rpartition(".")[2] for f in fields]
    return lambda s, d: _postings(s, d).select("job_id", column().alias("x")).select("job_id", *(F.col(f"x.{f}").alias(n) for f, n in zip(fields, names, strict=True)))


#: Raw answers as models write them, dealt out over orders, with what each stands for.
SKILL_NAMES = [("Structured Query Language", "sql"), (" PowerBI ", "power bi"), ("Python 3.11", "python"), ("Power-BI", "power bi"), ("R", "r"), ("Apache  Spark", "spark"), ("Data & ML.", "data and ml"), ("Tableau™", "tableau"), ("k8s", "kubernetes"), ("MSSQL", "microsoft sql server")]
WORK_NAMES = [("Fully remote", "Remote"), ("hybrid (3 days)", "Hybrid"), ("ON-SITE", "Onsite"), (None, "Unclear"), ("whatever", "Unclear"), ("Remote or in-office", "Onsite"), ("remote, then hybrid", "Hybrid"), ("working from home: wfh", "Remote"), ("", "Unclear")]
YEAR_NAMES = [("5+ years", 5.0), ("not stated", None), ("1,000 days", 1000.0), ("2.5", 2.5), (None, None), ("NaN", None), ("three", None)]
LISTS = [('["SQL", " Python "]', "SQL;Python"), ("['SQL', 'dbt']", "SQL;dbt"), ("SQL, Python|Excel;R", "SQL;Python;Excel;R"), ("none", ""), (None, ""), ("[]", ""), ("one", "one"), ("a\nb", "a;b")]
REPLIES = [
    ('```json\n{"salary_min": "$1,200", "pay_period": "monthly", "seniority": "", "required_skills": "SQL, dbt", "evidence": {"salary": "$1,200"}}\n```', (1200.0, "MONTHLY", None, 2, "$1,200", True)),
    ('{"salary_min": 90000, "pay_period": "YEARLY", "seniority": "Director", "required_skills": ["SQL", " "], "evidence": {}}', (90000.0, "YEARLY", "Director", 1, None, True)),
    ("I can't tell.", (None, None, None, 0, None, False)),
    ('{"salary_min": "about ten", "required_skills": []}', (None, None, None, 0, None, True)),
]


def _dealt(values: list) -> str:
    return S.choice("o_orderkey", ["null" if v is None else S.quoted([v])[0] for v in values])


def _answers(values: list):
    """The texts as Spark reads them: dealt out by an array, not by a text of SQL, so that no escapes are involved."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("o_orderkey") % len(values) + 1).cast("int"))


def _over_orders(values: list, **columns):
    return lambda s, d: S.table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), _answers(values).alias("raw")).select("job_id", *(make(F.col("raw")).alias(n) for n, make in columns.items()))


QUERIES = {
    "document_facts": document_facts,
    "extract_salary": _one(lambda: E.salary("description"), "low", "high", "period", "evidence"),
    "extract_seniority": _one(lambda: E.seniority(), "level"),
    "extract_years": _one(lambda: E.years("description"), "least"),
    "extract_arrangement": _one(lambda: E.arrangement("description"), "arrangement"),
    "extract_skills": lambda s, d: E.looked_at(_postings(s, d), "description").select("job_id", E.skills("description", seen=E.beside()).alias("x")).select("job_id", F.array_join("x.required", ",").alias("required"), F.array_join("x.preferred", ",").alias("preferred"), F.size("x.evidence").alias("n_evidence")),
    "canonical_skill": _over_orders([a for a, _ in SKILL_NAMES], skill=N.canonical_skill),
    "normalised_work": _over_orders([a for a, _ in WORK_NAMES], work=N.work),
    "normalised_years": _over_orders([a for a, _ in YEAR_NAMES], years=N.years),
    "parsed_lists": _over_orders([a for a, _ in LISTS], items=lambda c: F.array_join(N.parse_list(c), ";")),
    "normalised_replies": lambda s, d: N.replies(S.table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), _answers([a for a, _ in REPLIES]).alias("reply"))).select("job_id", "salary_min", "pay_period", "seniority", F.col("n_required"), "evidence_salary", "valid_json"),
}


def _case(key: str, values: list, when: str = "true") -> str:
    return f"case when {when} then {S.choice(key, ['null' if v is None else str(v) for v in values])} end"


def _text(values: list) -> list:
    return [None if v is None else S.quoted([v])[0] for v in values]


_HELD = "o_orderkey % 31 <> 0 and o_orderkey % 29 <> 0"
_LISTED = lambda i: S.choice("(o_orderkey + 3)", S.quoted(t[i] for t in SKILL_TEXTS))
_COUNT = S.choice("(o_orderkey + 3)", [str(len([x for x in f"{t[1]},{t[2]}".split(",") if x])) for t in SKILL_TEXTS])


def _sql(values: list, name: str, text: bool = True) -> str:
    shown = _text(values) if text else ["null" if v is None else str(v) for v in values]
    return f"select o_orderkey job_id, {S.choice('o_orderkey', ['null' if v is None else v for v in shown])} as {name} from orders"


def _column(i: int, text: bool) -> str:
    values = [r[1][i] for r in REPLIES]
    return S.choice("o_orderkey", ["null" if v is None else S.quoted([v])[0] if text else str(v).lower() for v in values])


SQL = {
    "extract_salary": f"select o_orderkey job_id, cast({_case('o_orderkey', [p[1] for p in PAYS], _HELD)} as double) low, cast({_case('o_orderkey', [p[2] for p in PAYS], _HELD)} as double) high, {_case('o_orderkey', _text([p[3] for p in PAYS]), _HELD)} period, {_case('o_orderkey', [p[4] for p in PAYS], _HELD)} evidence from orders",
    "extract_seniority": f"select o_orderkey job_id, {_case('o_orderkey', _text([t[1] for t in TITLES]))} as level from orders",
    "extract_years": f"select o_orderkey job_id, {_case('(o_orderkey + 7)', [y[1] for y in YEARS], _HELD)} as least from orders",
    "extract_arrangement": f"select o_orderkey job_id, coalesce({_case('(o_orderkey + 5)', _text([a[1] for a in ARRANGEMENTS]), _HELD)}, 'unclear') arrangement from orders",
    "extract_skills": f"select o_orderkey job_id, case when {_HELD} then {_LISTED(1)} else '' end required, case when {_HELD} then {_LISTED(2)} else '' end preferred, case when {_HELD} then {_COUNT} else 0 end n_evidence from orders",
    "canonical_skill": _sql([b for _, b in SKILL_NAMES], "skill"),
    "normalised_work": _sql([b for _, b in WORK_NAMES], "work"),
    "normalised_years": _sql([b for _, b in YEAR_NAMES], "years", False).replace("(case", "cast((case").replace("end) as", "end) as double) as"),
    "parsed_lists": _sql([b for _, b in LISTS], "items"),
    "normalised_replies": f"select o_orderkey job_id, cast({_column(0, False)} as double) salary_min, {_column(1, True)} pay_period, {_column(2, True)} seniority, cast({_column(3, False)} as int) n_required, {_column(4, True)} evidence_salary, {_column(5, False)} valid_json from orders",
}
