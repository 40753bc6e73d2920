"""The extractors on single texts."""

from pyspark.sql import functions as F

from quarryline.operators import extract as E
from quarryline.operators import normalise as N
from quarryline.plans import QUERIES

# Texts that must give these answers.
PAY = [
    ("Pay Range: The pay range for this role is: $ 109120.00 to $ 163680.00", (109120.0, 163680.0, "YEARLY")),
    ("Gross Weekly Pay: $1840.90 for this contract", (1840.90, 1840.90, "WEEKLY")),
    ("paying in the $50-60K range depending on experience", (50000.0, 60000.0, "YEARLY")),
    ("Base Rate: $20.55 - 23.00 per hour", (20.55, 23.0, "HOURLY")),
    ("NTT DATA, a $30 billion trusted global innovator", None),
    ("$224 billion in client assets. The salary range is $85,000 - $95,000 annually.", (85000.0, 95000.0, "YEARLY")),
    ("Salary Grade Minimum - Annual $108,400.00 ... Minimum - Hourly $52.12", (108400.0, 108400.0, "YEARLY")),
    ("Salary/Hourly Rate $130k - $180k Annually based on experience", (130000.0, 180000.0, "YEARLY")),
    ("salary range: $72,000 - $115,000. Note that hourly rates vary.", (72000.0, 115000.0, "YEARLY")),
    ("a rate of $33 per hour, W2", (33.0, 33.0, "HOURLY")),
    ("Compensation Ranges: $20 - $25 an hour", (20.0, 25.0, "HOURLY")),
    ("$85,000 per year. Standard 40 hours a week.", (85000.0, 85000.0, "YEARLY")),
    ("compensation of $33 annually per hour worked", (33.0, 33.0, "HOURLY")),
    ("Competitive compensation discussed during interview.", None),
    ("", None),
    (None, None),
]
TITLES = [
    ("Account Executive", None), ("Sales Executive", None), ("Enterprise Account Executive", None), ("Executive Assistant", None), ("Executive Administrative Assistant", None), ("Senior Account Executive, Influencer", "Mid-Senior level"), ("Division Chief, Classification & Compensation", None),
    ("Chief Financial Officer", "Executive"), ("Vice President Compliance", "Executive"), ("Director of Engineering", "Director"), ("Junior Data Analyst", "Entry level"), ("Marketing Intern", "Internship"), ("Pharmacy Technician", None), (None, None),
]
YEARS = [("Requires 3-5 years of relevant experience", 3), ("We have served customers for 10 years.", None), ("40 years of experience", None), (None, None)]
# Sentences of our own.
MORE_PAY = [
    ("We offer $500 at once. The range is $80,000 - $90,000 per year", (80000.0, 90000.0, "YEARLY")),
    ("between $90,000 - $80,000", (80000.0, 90000.0, "YEARLY")),
    ("$45 - $50", (45.0, 50.0, "HOURLY")),
    ("$120,000 an hour", (120000.0, 120000.0, "YEARLY")),
    ("$2,000 biweekly", (2000.0, 2000.0, "BIWEEKLY")),
    ("$3 million a year", None),
    ("x" * 200_000 + " $70K per annum", (70000.0, 70000.0, "YEARLY")),
]
MORE_TITLES = [("CFO", "Executive"), ("Head of Data", "Executive"), ("Senior Data Intern", "Internship"), ("Assistant to the CEO", None), ("Co-op Student", "Internship"), ("Associate", "Associate")]
MORE_YEARS = [("Experience required: 5 years", 5), ("5+ yrs experience, or 2 years of work experience", 2), ("experience" + " ." * 60 + " 4 years", None)]
WORK = [("This position is hybrid.", "hybrid"), ("This role is remote", "remote"), ("This job will be on-site", "onsite"), ("remote/onsite", "unclear"), ("If this role is listed as remote, this role is remote", "unclear"), ("On-site 2 days a week", "hybrid"), ("Great remote teams", "unclear"), (None, "unclear")]


def values(spark, cases, column):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string").select("i", column.alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_salary(spark):
    got = [v and (v.low, v.high, v.period) for v in values(spark, PAY + MORE_PAY, E.salary())]
    assert got == [w for _, w in PAY + MORE_PAY]


def test_seniority(spark):
    assert [v and v.level for v in values(spark, TITLES + MORE_TITLES, E.seniority("text"))] == [w for _, w in TITLES + MORE_TITLES]


def test_years(spark):
    assert [v and v.least for v in values(spark, YEARS + MORE_YEARS, E.years())] == [w for _, w in YEARS + MORE_YEARS]


def test_arrangement(spark):
    assert [v.arrangement for v in values(spark, WORK, E.arrangement())] == [w for _, w in WORK]


def test_skills(spark):
    cases = [("Advanced Excel required for this role. Tableau is a plus.", (["Excel"], ["Tableau"])), ("Strong JavaScript skills required", (["JavaScript"], [])), ("PowerBI", (["Power BI"], [])), ("Power-BI and Power BI", (["Power BI"], [])), (None, ([], []))]
    got = values(spark, cases, E.skills())
    assert [(v.required, v.preferred) for v in got] == [w for _, w in cases]
    assert got[0].evidence["Tableau"].endswith("Tableau is a plus.")


def test_evidence_context(spark):
    long = "abc " * 100 + "the\n\u00a0 Pay is $5 " + "x" * 300
    assert values(spark, [(long, 0)], N.evidence_context(F.col("text"), F.lit("Pay is $5"), 10))[0] == "abc the Pay is $5 xxxxxxxxx"
    assert values(spark, [(long, 0), (None, 0), ("Pay", 0)], N.evidence_context(F.col("text"), F.lit("pay")))[0] == "pay"
    assert values(spark, [(None, 0), ("Pay", 0)], N.evidence_context(F.col("text"), F.lit("Pay"))) == ["", "Pay"]


def test_json_objects(spark):
    cases = [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure: {"a": {"b": 2}} as asked', '{"a": {"b": 2}}'), ("[1]", None), ("} {", None), ("none", None), (None, None), ("{a}", None), ('x {"a": 1} {"b": 2}', None)]
    got = values(spark, cases, N.json_object(F.col("text")))
    assert [v.object for v in got] == [w for _, w in cases] and [v.error for v in got] == [None, None, None, "JSON, but no object", "no JSON", "no JSON", "no reply", "no JSON", "no JSON"]


def test_strict_arrangements(spark):
    cases = [(" Fully Remote\t", "remote"), ("In-Office", "onsite"), ("remote-ish", None), ("", None), (None, None), ("not specified", "unclear"), ("\u00a0hybrid", "hybrid")]
    assert values(spark, cases, N.strict_arrangement(F.col("text"))) == [w for _, w in cases]
    replies = [('{"work_arrangement": "remote", "evidence_work_arrangement": "", "stage1_evidence": {"role_specific_arrangement_text": "from home"}}', ("remote", "from home", None)), ('{"work_arrangement": "unclear", "evidence_work_arrangement": "x"}', ("unclear", None, None)), ('{"work_arrangement": "both"}', (None, None, "Invalid work_arrangement value: 'both'")), ("{}", (None, None, "Invalid work_arrangement value: None")), ("?", (None, None, "no JSON"))]
    got = N.arrangement_replies(spark.createDataFrame([(i, r) for i, (r, _) in enumerate(replies)], "i int, reply string")).orderBy("i").collect()
    assert [(r.work_arrangement, r.evidence_work_arrangement, r.validation_error) for r in got] == [w for _, w in replies]


def test_document_facts_keep_every_row(spark):
    data = "/root/testdata/sf0.001"
    assert QUERIES["document_facts"](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_phrases_are_looked_for_where_their_words_are(spark):
    """Every pattern's needed words are in the lower-cased text of what it matches, and a text without them isn't searched."""
    from quarryline.operators.patterns import wanted

    assert wanted(E.ARRANGEMENTS["hybrid"][0]) and all(wanted(p) for ps in [*E.ARRANGEMENTS.values(), E.UNCLEAR, E.PERIOD_HINTS.values()] for p in ps)
    texts = [("We need POSTGRES and Sql. Postgre is a Plus, mandatory", 0), ("postgresql nice-to-have", 0), ("none", 0)]
    got = values(spark, texts, E.skills())
    assert [sorted(v.required + v.preferred) for v in got] == [["PostgreSQL", "SQL"], ["PostgreSQL"], []] and got[1].preferred == ["PostgreSQL"]
    low = spark.createDataFrame([("this role is hybrid",), ("a role that is",), ("Hybrid".lower(),)], "t string").select(E.may(F.col("t"), E.ARRANGEMENTS["hybrid"][0]).alias("v")).collect()
    assert [r.v for r in low] == [True, False, False]


def test_equal_texts_are_read_once(spark):
    """Every posting keeps its row, whatever texts it shares; equal ones are read once, and only keys and digests are shuffled."""
    texts = [None, "", "-", "5 years of experience with SQL. " + "and so on " * 30, "This position is hybrid. " + "x" * 300, "$50 an hour"]
    rows = [(i, ["Senior Analyst", None, "1:"][i % 3], texts[i % len(texts)]) for i in range(600)]
    df = spark.createDataFrame(rows, "job_id bigint, title string, description string").repartition(5)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    make = lambda p: E.records(p, "title", "description").drop("evidence")
    got = E.once(df, "job_id", ["title", "description"], lambda p: make(p.mapInArrow(counted, p.schema)))
    assert sorted(map(str, got.collect())) == sorted(map(str, make(df).collect()))
    assert reads.value < 600  # short inputs are parted, long ones are read once
    long = E.once(df.where("length(description) > 200"), "job_id", ["description"], lambda p: p.select("job_id", F.lit(1).alias("x")))
    assert long.count() == 200
    plan = QUERIES["posting_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "isnotnull(unhex" not in plan.optimizedPlan().toString() and "ShuffledHashJoin" in plan.executedPlan().toString()


def test_patterns_begin_where_they_may(spark):
    """Led patterns match where the plain ones do; needed words are whole where alternatives begin alike."""
    from quarryline.operators import patterns as P

    assert P.needed(r"\bmachine learning\b|\bml\b") == ["learning", "ml"] and P.needed(r"\bgit\b|\bgithub\b") == ["git"]
    assert P.begun(r"\bon-?site\b") == r"on(?<=\bon)-?site\b" and P.begun(r"\bmails?\b") == r"mail(?<=\bmail)s?\b" and P.led("[^a]b") == "[^a]b" and P.led("a|") == "a|"
    every = [*E.SKILLS.values(), *E.PERIOD_HINTS.values(), E.YEARS, *E.UNCLEAR, *(p for ps in E.ARRANGEMENTS.values() for p in ps)]
    some = ["MySQL sql", "Machine Learning", "html ml", "PowerBI", "power -bi", "/hr", "an  hour", "BI-weekly", "3 - 5 yrs", "12345 years", "remote/on-site", "USA | Remote", "on-site two to 3 days a week", "athis role is remote; this role is remote", "Hybrid 2 days each week", "éml ml", "postgresql"]
    texts = spark.createDataFrame([(t,) for t in some], "t string")
    for p in every:
        a, b = (F.split("t", f"(?i){x}", -1) for x in (p, P.led(p)))
        assert texts.where(a != b).count() == 0, p


def test_skills_by_columns_beside_the_text(spark):
    """One look beside the text gives what the text alone gives, whatever its characters; first places are found in a projection of
    their own, not inside a lambda."""
    some = [None, "", "SQL", "Kafka İ PYTHON required, exposure to ÉTL", "é" * 300 + "sql is a plus" + "x" * 240 + "required", "😀 Git and GITHUB preferred 😀 bonus: Javascript, java; aws", "nice to havexposure to dbt. Must have dbt or Power-BI", "a plus a plus SPARK bonus a plus", "x" * 400 + " Apache  Spark " + "preferred" + "y" * 300 + "required machine learning ML", "mandatory\nexcel\x00 ideally\tElt\x85 sas", "REQUIRED " * 40 + "vba" + " PREFERRED" * 40]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(some * 2)], "i int, text string")
    own = E.SKILLS | {"Any": "[x-z]", "Upper": "SQL|Dbt", "None": "qqq", "Class": r"excel[^a-z]", "Flag": "(?-i)Javascript"}
    for patterns in (E.SKILLS, own):
        beside = E.looked_at(texts, "text", patterns).select("i", E.skills("text", patterns, seen=E.beside()).alias("x"))
        alone = texts.select("i", E.skills("text", patterns).alias("x"))
        assert sorted(map(str, beside.collect())) == sorted(map(str, alone.collect()))
    plan = E.looked_at(texts, "text").select(E.skills(seen=E.beside()))._jdf.queryExecution().executedPlan().toString()
    made = next(line for line in plan.splitlines() if "AS _found" in line)
    assert "flatten(array(" in made and "transform(_found" not in made


def test_patterns_in_lower_case(spark):
    """Which patterns may be looked for as they are in a lower-cased text; what is one of several alternatives isn't begun with the first."""
    from quarryline.operators import patterns as P

    assert all(map(P.caseless, E.SKILLS.values())) and not any(map(P.caseless, ("A", "[@-_]", r"\x41", r"\S", "(?i)a", "(?-i)a", r"\1")))
    assert P.led(r"\baws\b|\bamazon\b") == r"(?=[a])(?:\baws\b|\bamazon\b)" and P.led(r"\bthis (?:a|b)") == r"this (?<=\bthis )(?:a|b)"


def test_strings_of_one_number_are_one_look(spark):
    """Texts hold what they hold however many strings begin alike; strings of one number are asked for together."""
    from quarryline.operators import patterns as P

    words = sorted({*E.searched(E.SKILLS), "ab", "abc", "abcd", "bc"})
    texts = ["abcab", "", None, "ab", "xbc", "a", "power sql", "ed" * 50 + "required", "é", " ".join(words)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).withColumn("h", P.occurring(words)("t")).select("i", *(P.holds(F.col("h"), words, [w]).alias(f"w{k}") for k, w in enumerate(words))).orderBy("i").collect()
    assert [list(r)[1:] for r in got] == [[None if t is None else w in t for w in words] for t in texts]
    assert P.holds(F.col("h"), words, words)._jc.toString().count("&") == -(-len(words) // P.BITS)
