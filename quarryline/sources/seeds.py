"""The skill patterns, the names of skills and arrangements, and the texts of made-up postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Technologies as (name, category, pattern, order of display).
SKILL_PATTERNS = [
    ("SQL", "Programming and query languages", r"(?i)(^|[^a-z0-9])sql([^a-z0-9]|$)", 1),
    ("Python", "Programming and query languages", r"(?i)(^|[^a-z0-9])python([^a-z0-9]|$)", 2),
    ("R", "Programming and query languages", r"(?i)(r programming|r language|rstudio|python\s*/\s*r|r\s*/\s*python)", 3),
    ("Java", "Programming and query languages", r"(?i)(^|[^a-z0-9])java([^a-z0-9]|$)", 4),
    ("Scala", "Programming and query languages", r"(?i)(^|[^a-z0-9])scala([^a-z0-9]|$)", 5),
    ("Excel", "BI and visualization", r"(?i)(microsoft excel|ms excel|(^|[^a-z0-9])excel([^a-z0-9]|$))", 10),
    ("Tableau", "BI and visualization", r"(?i)(^|[^a-z0-9])tableau([^a-z0-9]|$)", 11),
    ("Power BI", "BI and visualization", r"(?i)power\s*bi", 12),
    ("Looker", "BI and visualization", r"(?i)(^|[^a-z0-9])looker([^a-z0-9]|$)", 13),
    ("Qlik", "BI and visualization", r"(?i)(qlikview|qlik sense|(^|[^a-z0-9])qlik([^a-z0-9]|$))", 14),
    ("AWS", "Cloud platforms", r"(?i)(amazon web services|(^|[^a-z0-9])aws([^a-z0-9]|$))", 20),
    ("Azure", "Cloud platforms", r"(?i)(microsoft azure|(^|[^a-z0-9])azure([^a-z0-9]|$))", 21),
    ("Google Cloud", "Cloud platforms", r"(?i)(google cloud platform|google cloud|(^|[^a-z0-9])gcp([^a-z0-9]|$))", 22),
    ("Snowflake", "Data platforms and warehouses", r"(?i)(^|[^a-z0-9])snowflake([^a-z0-9]|$)", 30),
    ("Databricks", "Data platforms and warehouses", r"(?i)(^|[^a-z0-9])databricks([^a-z0-9]|$)", 31),
    ("BigQuery", "Data platforms and warehouses", r"(?i)(bigquery|big query)", 32),
    ("Redshift", "Data platforms and warehouses", r"(?i)(amazon redshift|(^|[^a-z0-9])redshift([^a-z0-9]|$))", 33),
    ("PostgreSQL", "Data platforms and warehouses", r"(?i)(postgresql|postgres)", 34),
    ("MySQL", "Data platforms and warehouses", r"(?i)(^|[^a-z0-9])mysql([^a-z0-9]|$)", 35),
    ("Oracle", "Data platforms and warehouses", r"(?i)(oracle database|oracle sql|oracle db)", 36),
    ("MongoDB", "Data platforms and warehouses", r"(?i)(^|[^a-z0-9])mongodb([^a-z0-9]|$)", 37),
    ("NoSQL", "Data platforms and warehouses", r"(?i)(^|[^a-z0-9])nosql([^a-z0-9]|$)", 38),
    ("Apache Spark", "Big data and streaming", r"(?i)(apache spark|pyspark)", 40),
    ("Hadoop", "Big data and streaming", r"(?i)(^|[^a-z0-9])hadoop([^a-z0-9]|$)", 41),
    ("Kafka", "Big data and streaming", r"(?i)(apache kafka|(^|[^a-z0-9])kafka([^a-z0-9]|$))", 42),
    ("dbt", "Transformation and orchestration", r"(?i)(^|[^a-z0-9])dbt([^a-z0-9]|$)", 50),
    ("Airflow", "Transformation and orchestration", r"(?i)(apache airflow|(^|[^a-z0-9])airflow([^a-z0-9]|$))", 51),
    ("Informatica", "Transformation and orchestration", r"(?i)(^|[^a-z0-9])informatica([^a-z0-9]|$)", 52),
    ("Alteryx", "Transformation and orchestration", r"(?i)(^|[^a-z0-9])alteryx([^a-z0-9]|$)", 53),
    ("SAS", "Analytics and machine learning", r"(?i)(^|[^a-z0-9])sas([^a-z0-9]|$)", 60),
    ("Pandas", "Analytics and machine learning", r"(?i)(^|[^a-z0-9])pandas([^a-z0-9]|$)", 61),
    ("NumPy", "Analytics and machine learning", r"(?i)(^|[^a-z0-9])numpy([^a-z0-9]|$)", 62),
    ("Scikit-learn", "Analytics and machine learning", r"(?i)(scikit-learn|scikit learn|sklearn)", 63),
    ("TensorFlow", "Analytics and machine learning", r"(?i)(^|[^a-z0-9])tensorflow([^a-z0-9]|$)", 64),
    ("PyTorch", "Analytics and machine learning", r"(?i)(^|[^a-z0-9])pytorch([^a-z0-9]|$)", 65),
    ("Git", "Engineering tools", r"(?i)(github|gitlab|(^|[^a-z0-9])git([^a-z0-9]|$))", 70),
    ("Docker", "Engineering tools", r"(?i)(^|[^a-z0-9])docker([^a-z0-9]|$)", 71),
    ("Kubernetes", "Engineering tools", r"(?i)(kubernetes|(^|[^a-z0-9])k8s([^a-z0-9]|$))", 72),
    ("Jira", "Engineering tools", r"(?i)(^|[^a-z0-9])jira([^a-z0-9]|$)", 73),
]

# Role families by title, the first rule that matches.
ROLE_FAMILIES = [
    ("Analytics Engineer", "analytics engineer"),
    ("Data Engineer", "data engineer|etl developer|data platform"),
    ("Data Scientist", "data scientist|machine learning engineer|ml engineer"),
    ("Data Analyst", "data analyst|data analytics"),
    ("BI Analyst", "business intelligence|bi analyst|bi developer|reporting analyst"),
    ("Business Analyst", "business analyst"),
    ("Product Analyst", "product analyst"),
]

# Texts of made-up postings with what a right extractor finds in them.
#: title, level
TITLES = [
    ("Senior Data Analyst", "Mid-Senior level"), ("Data Engineer", None), ("Data Scientist II", None), ("Junior Business Analyst", "Entry level"), ("BI Developer", None), ("Analytics Engineer Intern", "Internship"), ("Account Executive", None), ("Executive Assistant to the CEO", None),
    ("Chief Data Officer", "Executive"), ("Head of Product Analyst Team", "Executive"), ("Director of Data Platform", "Director"), ("Associate Product Analyst", "Associate"), ("Pharmacy Technician", None), ("Senior Data Intern", "Internship"),
]
#: text as SQL over orders, then SQL of low, high, period and evidence
_P = "cast(cast(floor(o_totalprice) as bigint) % 80 + 20 as varchar(20))"  # 20 to 99
PAYS = [
    (f"'Pay is $' || {_P} || ' per hour.'", _P, _P, "HOURLY", f"'$' || {_P}"),
    (f"'Pay is $' || {_P} || ',000 - $1' || {_P} || ',000 annually.'", f"{_P} || '000'", f"'1' || {_P} || '000'", "YEARLY", f"'$' || {_P} || ',000 - $1' || {_P} || ',000'"),
    (f"'We own $' || {_P} || ' billion of assets.'", None, None, None, None),
    (f"'Pay is $' || {_P} || 'K per year.'", f"{_P} || '000'", f"{_P} || '000'", "YEARLY", f"'$' || {_P} || 'K'"),
    (f"'A gift of $500 first. Pay is $1' || {_P} || ',000 to $' || {_P} || ',000 per annum.'", f"{_P} || '000'", f"'1' || {_P} || '000'", "YEARLY", f"'$1' || {_P} || ',000 to $' || {_P} || ',000'"),
    ("'Pay is agreed on in the interview.'", None, None, None, None),
    (f"'Pay is $' || {_P} || '-2' || {_P} || 'K, not hourly but per year'", f"{_P} || '000'", f"'2' || {_P} || '000'", "YEARLY", f"'$' || {_P} || '-2' || {_P} || 'K'"),
    (f"'Pay is $3,6' || {_P} || ' per month.'", f"'36' || {_P}", f"'36' || {_P}", "MONTHLY", f"'$3,6' || {_P}"),
    (f"'Pay is $' || {_P} || ' annually per hour worked.'", _P, _P, "HOURLY", f"'$' || {_P}"),
    (f"'Pay is $2,0' || {_P} || ' bi-weekly.'", f"'20' || {_P}", f"'20' || {_P}", "BIWEEKLY", f"'$2,0' || {_P}"),
    (f"'Pay: $45.50 - ' || {_P} || '0'", "'45.5'", f"{_P} || '0'", "HOURLY", f"'$45.50 - ' || {_P} || '0'"),
]
#: text, required, preferred
SKILL_TEXTS = [
    ("Advanced Excel required for this role. Tableau is a plus.", "Excel", "Tableau"),
    ("We work with SQL and Python here.", "Python,SQL", ""),
    ("Familiarity with PowerBI is nice to have.", "", "Power BI"),
    ("Strong JavaScript is essential for us.", "JavaScript", ""),
    ("No tools are named.", "", ""),
    ("Ideally you know Apache Spark and Kafka.", "", "Kafka,Spark"),
    ("Snowflake, dbt and Airflow are mandatory; AWS would be great.", "Airflow,Snowflake,dbt", "AWS"),
]
#: text, arrangement
ARRANGEMENTS = [
    ("This position is hybrid from our office.", "hybrid"), ("This role will be fully remote for you.", "remote"), ("This job is on-site in our plant.", "onsite"), ("Our remote teams are great.", "unclear"), ("If this position is listed as open, this role is remote.", "unclear"),
    ("We are remote / on-site as it fits.", "unclear"), ("Expect on-site work two to three days per week.", "hybrid"), ("Remote work is not available to anyone.", "onsite"), ("Location: USA | Remote", "remote"),
]
#: text, least years
YEARS = [
    ("Requires 3-5 years of relevant experience.", 3), ("We have served customers for 10 years.", None), ("Experience required: 5 years", 5), ("40 years of experience in sum.", None), ("5+ yrs experience, or 2 years of work experience.", 2), ("Nothing is asked for.", None), ("At least 7 plus years with data; experience counts.", 7),
]


def skill_patterns(spark: SparkSession) -> DataFrame:
    """The seed as a table."""
    return spark.createDataFrame(SKILL_PATTERNS, "skill_name string, skill_category string, regex_pattern string, display_order int")
