"""Normal forms of what annotators and models write, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let

# Other names of skills and arrangements.
SKILL_ALIASES = {
    "structured query language": "sql", "sql server": "microsoft sql server", "ms sql server": "microsoft sql server", "mssql": "microsoft sql server", "postgres": "postgresql", "postgre sql": "postgresql", "powerbi": "power bi", "power-bi": "power bi",
    "google big query": "bigquery", "google bigquery": "bigquery", "amazon web services": "aws", "microsoft azure": "azure", "google cloud": "gcp", "google cloud platform": "gcp", "apache spark": "spark", "apache airflow": "airflow", "apache kafka": "kafka",
    "snowflake data cloud": "snowflake", "data build tool": "dbt", "tableau desktop": "tableau", "ms excel": "excel", "microsoft excel": "excel", "git hub": "github", "k8s": "kubernetes",
}
WORK_ALIASES = {
    "remote": "Remote", "fully remote": "Remote", "100% remote": "Remote", "work from home": "Remote", "wfh": "Remote", "hybrid": "Hybrid", "hybrid remote": "Hybrid", "hybrid/remote": "Hybrid", "onsite": "Onsite", "on site": "Onsite", "on-site": "Onsite", "in office": "Onsite", "office": "Onsite",
    "not stated": "Unclear", "unknown": "Unclear", "unclear": "Unclear", "ambiguous": "Unclear", "none": "Unclear", "null": "Unclear", "": "Unclear",
}
NO_YEARS = ["", "none", "null", "nan", "not stated", "unknown", "unclear"]
NO_LIST = ["", "none", "null", "nan", "[]"]


# Strict names of arrangements; any other answer is invalid.
ARRANGEMENT_LABELS = {
    "remote": "remote", "fully remote": "remote", "work from home": "remote", "work-from-home": "remote", "virtual": "remote", "hybrid": "hybrid", "on site": "onsite", "on-site": "onsite", "onsite": "onsite", "in office": "onsite", "in-office": "onsite", "office based": "onsite", "office-based": "onsite",
    "unclear": "unclear", "unknown": "unclear", "not specified": "unclear", "not stated": "unclear",
}


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: A text that has no white space at all, or none at its ends: most are, and one look is cheaper than replacing.
_SOLID, _BARE = r"\A[!-~]*\z", r"(?s)\A[!-~](?:.*[!-~])?\z"


def bare(c: Column) -> Column:
    """``stripped`` of what is at hand (a lambda's variable), by a look at its ends first."""
    return F.when(c.rlike(_BARE), c).otherwise(stripped(c))


def collapsed(c: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _aliases(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def canonical_skill(c: Column) -> Column:
    """Lower case, without marks, outer punctuation and the versions of known tools; obvious aliases merged."""
    plain = c.rlike(r"\A[a-z0-9]+\z")  # as it should be already
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), "&", " and "), "[™®]", ""), r"\s+", " ")
    text = F.regexp_replace(text, r"^[ .,:;()\[\]{}]+|[ .,:;()\[\]{}]+$", "")
    text = F.regexp_replace(text, r"^(python|tableau|excel|spark)\s+\d+(?:\.\d+)*$", "$1")
    return let(F.when(plain, c).otherwise(text), lambda t: F.coalesce(F.try_element_at(_aliases(SKILL_ALIASES), t), t))


def skill_set(c: Column) -> Column:
    """The distinct canonical names of a list, in order; nameless ones go. No null is left, so ``sort_array``, which compares
    without a lambda, gives the order of ``array_sort``."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(c, canonical_skill), lambda x: x.isNotNull() & (x != ""))))


#: A list as it should be: lower-case words of letters and digits, parted by commas.
_PLAIN_LIST = r"\A[a-z0-9]++(?:, ?[a-z0-9]++)*+\z"


def listed_skills(c: Column) -> Column:
    """``skill_set(parse_list(c))``. A plain list of names that stand for themselves is only split, a single name is the list: no lambda,
    which Spark would interpret item by item."""
    plain = reduce(Column.__and__, [~c.contains(a) for a in SKILL_ALIASES if a.isalnum()], c.rlike(_PLAIN_LIST))
    empty = c.isNull() | c.isin(NO_LIST)
    split = F.when(c.contains(","), F.sort_array(F.array_distinct(F.split(F.replace(c, F.lit(", "), F.lit(",")), ",")))).otherwise(F.array(c))
    return F.when(empty, F.array().cast("array<string>")).when(plain, split).otherwise(skill_set(parse_list(c)))


def work(c: Column) -> Column:
    """Remote, Hybrid, Onsite or Unclear; verbose answers by what they name, hybrid before onsite before remote."""
    text = let(F.coalesce(c, F.lit("")), lambda t: F.lower(F.when(t.rlike(_SOLID), t).otherwise(collapsed(t))))
    named = lambda t: F.when(t.contains("hybrid"), "Hybrid").when(t.rlike("on-site|onsite|on site|in-office|in office"), "Onsite").when(t.rlike("remote|work from home|wfh"), "Remote").otherwise("Unclear")
    # most answers are the names themselves
    return F.when(c.isin(sorted(set(WORK_ALIASES.values()))), c).otherwise(let(text, lambda t: F.coalesce(F.try_element_at(_aliases(WORK_ALIASES), t), named(t))))


def years(c: Column) -> Column:
    """The first number of an answer; null if it names none."""
    text = F.lower(stripped(c.cast("string")))
    number = F.regexp_extract(F.regexp_replace(text, ",", ""), r"\d+(?:\.\d+)?", 0)
    return F.when(~text.isin(NO_YEARS) & (number != ""), number.try_cast("double"))


def parse_list(c: Column) -> Column:
    """A list written as JSON, with single quotes, or parted by commas, semicolons, bars or line ends; blank items go."""
    kept = lambda xs: F.filter(F.transform(xs, bare), lambda x: x.isNotNull() & (x != ""))
    nothing = F.array().cast("array<string>")

    def parsed(t: Column) -> Column:
        items = F.coalesce(F.from_json(t, "array<string>"), F.from_json(F.regexp_replace(t, "'", '"'), "array<string>"))
        return F.when(t.isNull() | F.lower(t).isin(NO_LIST), nothing).otherwise(kept(F.coalesce(F.when(t.startswith("["), items), F.split(t, r"\s*(?:,|;|\||\n)\s*"))))

    return let(let(c, bare), parsed)


def coerced_number(c: Column) -> Column:
    return F.regexp_replace(c, "[$,]", "").try_cast("double")


def unfenced(c: Column) -> Column:
    """A reply without the fence of a code block around it."""
    return stripped(F.regexp_replace(c, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def json_object(reply: Column) -> Column:
    """``struct(object, error)``: the JSON object that a reply is, but for a fence around it, or else that stands between its
    first and last brace; or what is wrong. A reply that is JSON, but no object, is wrong as a whole."""
    is_json = lambda t: F.coalesce(F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1, F.lit(False))  # noqa: E731  just one value, nothing after it

    def found(t: Column) -> Column:
        first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        inner = F.when((first > 0) & (F.instr(t, "}") > 0) & (last > first), F.substring(t, first, last - first + 1))
        good = F.when(t.startswith("{") & t.endswith("}") & is_json(t), t).when(~is_json(t) & is_json(inner), inner)
        error = F.when(good.isNotNull(), F.lit(None)).when(t.isNull(), "no reply").when(is_json(t), "JSON, but no object").otherwise("no JSON")
        return F.struct(good.alias("object"), error.alias("error"))

    return let(unfenced(reply), found)


def replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """A model's JSON replies flattened into the shape of the rules' output; replies that are no JSON object give nulls
    and empty lists, and ``valid_json`` false."""
    text = json_object(F.col(reply))["object"]
    field = lambda name: F.get_json_object("_t", f"$.{name}")
    listed = lambda name: F.coalesce(parse_list(field(name)), F.array().cast("array<string>"))
    said = lambda name: F.when(field(name) != "", field(name))
    valid = F.col("_t").isNotNull()
    flat = df.withColumn("_t", text).withColumns(
        {
            "valid_json": F.coalesce(valid, F.lit(False)), "salary_min": coerced_number(field("salary_min")), "salary_max": coerced_number(field("salary_max")), "pay_period": F.upper(said("pay_period")), "seniority": said("seniority"), "years_experience_min": coerced_number(field("years_experience_min")),
            "required_skills": listed("required_skills"), "preferred_skills": listed("preferred_skills"), "evidence_salary": said("evidence.salary"), "evidence_seniority": said("evidence.seniority"), "evidence_years": said("evidence.years_experience"),
        }
    )
    return flat.withColumns({"n_required": F.size("required_skills"), "n_preferred": F.size("preferred_skills")}).drop("_t", reply)


def strict_arrangement(c: Column) -> Column:
    """remote, hybrid, onsite or unclear by a fixed list of names; null for anything else."""
    return F.try_element_at(_aliases(ARRANGEMENT_LABELS), F.lower(stripped(c)))


def arrangement_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Replies about the arrangement, flattened: a strict label, its evidence (that of the first stage where the answer
    has none of its own; none for unclear ones, which have no evidence about this role), and what is wrong."""
    parsed = df.withColumn("_p", json_object(F.col(reply)))
    field = lambda path: F.get_json_object("_p.object", f"$.{path}")
    said = lambda path: F.when(field(path) != "", field(path))
    label = strict_arrangement(field("work_arrangement"))
    evidence = F.coalesce(said("evidence_work_arrangement"), said("stage1_evidence.role_specific_arrangement_text"))
    told = F.coalesce(F.concat(F.lit("'"), field("work_arrangement"), F.lit("'")), F.lit("None"))
    wrong = F.when(F.col("_p.object").isNull(), F.coalesce("_p.error", F.lit("Invalid JSON"))).when(label.isNull(), F.concat(F.lit("Invalid work_arrangement value: "), told))
    return parsed.withColumns({"work_arrangement": label, "evidence_work_arrangement": F.when(label.isNull() | (label != "unclear"), evidence), "valid_json": F.col("_p.object").isNotNull(), "valid_arrangement": label.isNotNull(), "parse_error": F.col("_p.error"), "validation_error": wrong}).drop("_p", reply)


#: Width of the text around a quoted piece of evidence.
AROUND = 130


def evidence_context(text: Column, quoted: Column, around: int = AROUND) -> Column:
    """The text around the first place of a quotation, white space collapsed; the quotation itself where the text
    doesn't have it; empty without a text or a quotation."""
    at = F.instr(text, quoted)
    low = F.greatest(at - around, F.lit(1))
    cut = F.substring(text, low, at - low + F.length(quoted) + around)
    return F.when(text.isNull() | quoted.isNull(), "").when(at == 0, quoted).otherwise(collapsed(cut))
