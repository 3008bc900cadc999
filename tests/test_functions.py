import math
import uuid

import pytest
from pyspark.sql import functions as F

from skilltide.functions import ids, skills, vectors
from skilltide.functions import text as X

TITLE_KEYS = [
    ("Software Engineer", "software engineer"), ("SOFTWARE ENGINEER", "software engineer"),
    ("Software   Engineer", "software engineer"),
    ("Senior Software Engineer", "software engineer"),
    ("Sr. Software Engineer", "software engineer"),
    ("Junior Backend Engineer", "backend engineer"),
    ("Principal Engineer", "engineer"), ("Software Engineer II", "software engineer ii"),
    ("New Grad Software Engineer", "software engineer"),
    ("Software Engineer (New Grad)", "software engineer"),
    ("Entry Level Data Analyst", "data analyst"),
    ("Backend Engineer (Hybrid - NYC)", "backend engineer"),
    ("Data Scientist [Contract]", "data scientist"),
    ("Frontend Engineer | Google", "frontend engineer"),
    ("Data Engineer | Remote | $150k", "data engineer"),
    ("2025 New Grad Software Engineer", "software engineer"),
    ("Software Engineer, Backend (Remote) - 2026 Start", "software engineer backend start"),
    ("C++ Engineer", "c++ engineer"), ("C# Developer", "c# developer"),
    ("ML/AI Engineer", "ml/ai engineer"),
    ("Research & Development Engineer", "research & development engineer"),
    ("Front-End Developer", "front-end developer"), ("Node.js Developer", "node js developer"),
    ("\U0001f468‍\U0001f4bb Software Engineer \U0001f680", "software engineer"),
    ("Ｓoftware Engineer", "software engineer"), ("", ""), ("   ", ""),
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, fn, kind="string"):
    rows = column(spark, values, kind).select("i", fn("v").alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_title_keys(spark):
    raw = [r for r, _ in TITLE_KEYS]
    assert apply(spark, raw, X.title_key) == [k for _, k in TITLE_KEYS]
    levels = apply(spark, ["Software Engineer II"], lambda c: X.title_key(c, strip_levels=True))
    assert levels == ["software engineer"]


def test_ascii_title_key_needs_no_python(spark):
    plan = column(spark, ["a"]).select(X.title_key("v", ascii_only=True))
    assert "Python" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("title,seniority,year", [
    ("New Grad Backend Engineer", "new_grad", None), ("Senior Software Engineer 2026", "senior", 2026),
    ("Data Scientist Intern", "intern", None), ("Staff ML Engineer", "senior", None),
    ("Backend Engineer", "unknown", None), ("Senior Intern", "intern", None),
    ("Internal Tools Engineer", "unknown", None), ("", "unknown", None), (None, "unknown", None)])
def test_facets(spark, title, seniority, year):
    assert apply(spark, [title], X.seniority) == [seniority]
    assert apply(spark, [title], X.posting_year) == [year]
    wanted = None if seniority == "unknown" else seniority
    assert apply(spark, [title], X.query_seniority_filter) == [wanted]


def test_year_falls_back_to_the_date(spark):
    df = spark.createDataFrame([("Engineer 2024", "2026-01-15"), ("Engineer", "2026-01-15"),
                                ("Engineer 1999", None)], "t string, d string")
    got = df.select(X.posting_year("t", F.to_date("d")).alias("y")).collect()
    assert [r.y for r in got] == [2024, 2026, None]


def test_small_text_functions(spark):
    assert apply(spark, ["  Senior\t Backend\nEngineer "], X.normalize_query) == [
        "senior backend engineer"]
    assert apply(spark, ["A&B  Corp.", "", None, "***"], X.slug) == [
        "a_b_corp", "untitled", "untitled", "untitled"]
    assert apply(spark, ["backend developer", "swe", "developer advocate", "reprogrammer"],
                 X.rewrite_head_noun) == ["backend engineer", "engineer", "developer advocate",
                                          "reprogrammer"]
    assert apply(spark, ["ml platform engineer"], X.display_title) == ["ML Platform Engineer"]


@pytest.mark.parametrize("a,b,expected", [
    ("word", "two words", 4 / 11), ("embeded engineer", "Embedded Engineer", 15 / 18),
    ("bakend engneer", "backend engineer", 11 / 21), ("", "", 0.0), ("abc", "", 0.0),
    ("same", "same", 1.0)])
def test_similarity(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(X.trigram_similarity("a", "b")).first()[0] == pytest.approx(expected)


@pytest.mark.parametrize("raw,expected", [
    ("CI/CD", ["ci", "cd"]), ("Next.js", ["nextjs"]), ("vue", ["Vue.js"]), ("Vue.js", ["Vue"]),
    ("C/C++ (Linux)", ["C", "c++ linux"]), ("!!!", [""]), ("python !", ["python "]),
    ("spark", ["Apache Spark"]), ("pandas", ["Pandas"]), ("scikit-learn", ["scikitlearn"]),
    ("Node.js", ["nodejs"]), ("  Python  ", ["Python"]), ("Python!!", ["Python"]),
    ("C#/C++", ["C#", "C++"]), ("js", ["JavaScript"])])
def test_skill_spelling(spark, raw, expected):
    assert apply(spark, [raw], skills.normalize_skill) == [expected]


def test_clean_skills(spark):
    own = ({"js": "JavaScript", "py": "Python"},
           {"python": "Python", "javascript": "JavaScript", "c++": "C++", "c#": "C#",
            "docker": "Docker"})
    got = apply(spark, [["Python", "js", "C++/C#", "Docker", "py"], ["Python", None, "js"], None],
                lambda c: skills.clean_skills(c, *own), "array<string>")
    assert got == [["C#", "C++", "Docker", "JavaScript", "Python"], ["JavaScript", "Python"], []]


def test_extractor_reply(spark):
    replies = ['{"skills":["Python",42,null,"js"]}', '{"job_title":"x"}', '{"skills":"Python"}',
               '{"skills":["Python"', '{"skills":null}', None]
    assert apply(spark, replies, skills.parse_skills_json) == [
        ["Python", "js"], [], ["Python"], None, [], None]


def test_uuid5_and_keys(spark):
    url = "https://www.linkedin.com/jobs/view/senior-backend-engineer-4317707969?refId=x"
    names = ["", "a", "é|ü", url, "x" * 500]
    assert apply(spark, names, lambda c: ids.uuid5(ids.URL_NAMESPACE, c)) == [
        str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    urls = [url, "https://example.com/a", "", None, "not a url %%"]
    assert apply(spark, urls, ids.posting_key) == [
        "linkedin:4317707969", "https://example.com/a", "", None, "not a url %%"]
    assert apply(spark, urls[:3], ids.posting_id) == [
        str(uuid.uuid5(uuid.NAMESPACE_URL, "linkedin:4317707969")),
        str(uuid.uuid5(uuid.NAMESPACE_URL, "https://example.com/a")), None]


def test_content_hash(spark):
    df = spark.createDataFrame([("Acme ", " Senior\n Engineer", "a  B"),
                                (None, "senior engineer", "a b")], "c string, t string, d string")
    rows = df.select(ids.content_key("c", "t", "d").alias("k"),
                     ids.content_hash("c", "t", "d").alias("h")).collect()
    assert [r.k for r in rows] == ["acme|senior engineer|a b", "|senior engineer|a b"]
    assert [r.h for r in rows] == [str(uuid.uuid5(uuid.NAMESPACE_URL, r.k)) for r in rows]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    row = df.select(vectors.cosine("a", "b").alias("c"), vectors.l2_normalize("a").alias("n"),
                    vectors.round_vector(F.array(F.lit(0.12345678))).alias("r")).first()
    assert row.c == pytest.approx(24 / 25) and row.n == pytest.approx([0.6, 0.8])
    assert row.r == [0.123457]
    got = apply(spark, ["backend engineer", ""], vectors.hashed_trigram_vector)
    assert math.isclose(sum(x * x for x in got[0]), 1, rel_tol=1e-5) and set(got[1]) == {0.0}
