import datetime
import json
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from skilltide import schemas
from skilltide.functions import text as X
from skilltide.operators import extract, mining, report
from skilltide.operators.scale import cut_lineage
from skilltide.plans.catalog import build_catalog
from skilltide.plans.ingest import COLUMNS, build_postings, raw_from_pages, split_failures
from skilltide.sources import pages, postings, tables
from skilltide.sources.key_index import KeyIndex
from skilltide.streaming.ingest import ingest_batch, start_ingest

URL = "https://www.linkedin.com/jobs/view/senior-backend-engineer-4317707969?refId=x"


def raw(**changes):
    row = {"job_title": "Senior Backend Engineer", "company": "Acme",
           "job_description": "We need Python, Go and GitHub Actions.", "job_url": URL,
           "posted_date": "2026-01-15"}
    row.update(changes)
    return row


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.RAW_POSTING.fields) for r in rows],
                                 schemas.RAW_POSTING)


def test_build_posting(spark):
    built = build_postings(frame(spark, raw()))
    row = built.first()
    assert row.posting_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "linkedin:4317707969"))
    assert row.skills == ["GitHub", "GitHub Actions", "Go", "Python"]
    assert (row.seniority, row.posting_year) == ("senior", 2026)
    assert row.posted_date == datetime.date(2026, 1, 15) and row.error is None
    assert row.content_hash == str(uuid.uuid5(
        uuid.NAMESPACE_URL, "acme|senior backend engineer|we need python, go and github actions."))
    for mine, fixed in zip(built.select(*COLUMNS).schema, schemas.POSTING.fields):
        assert mine.name == fixed.name
        assert mine.dataType.simpleString() == fixed.dataType.simpleString()


def test_plugged_functions_and_failures(spark):
    def extractor(text):
        if "boom" in text:
            raise RuntimeError("model down")
        return '{"skills": ["Python", "js"' + ("]}" if "cut" not in text else "")

    def embedder(texts):
        return [[float(len(t)), 0.5] for t in texts]

    df = frame(spark, raw(job_title="ok", job_url=None), raw(job_description="boom"),
               raw(job_description="cut"), raw(posted_date="soon"),
               raw(job_title=None, company=None, job_description=None, posted_date=None))
    good, dead = split_failures(build_postings(df, extractor=extractor, embedder=embedder))
    rows = good.orderBy(F.desc("job_title")).collect()
    assert rows[0].skills == ["JavaScript", "Python"] and rows[0].title_embedding == [2.0, 0.5]
    assert uuid.UUID(rows[0].posting_id).version == 4
    assert rows[1].job_title == "" and rows[1].company is None and rows[1].posted_date is None
    assert sorted(r.error for r in dead.collect()) == [
        "bad posted_date", "extraction failed", "extraction failed"]


def test_gazetteer(spark):
    text = "We use Amazon Web Services, c++ / C# and node.js. Python!"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id int, t string")
    names = ["amazon web services", "c++", "c#", "node.js", "python", "go"]
    got = df.select("id", extract.gazetteer_skills("t", names).alias("s")).orderBy("id").collect()
    assert got[0].s == ["amazon web services", "c#", "c++", "node.js", "python"] and got[1].s == []
    joined = extract.gazetteer_join(
        df, extract.alias_frame(df, [{n: n for n in names}]), id_col="id", text_col="t")
    assert sorted(r.skill for r in joined.collect()) == got[0].s


def test_spellings_are_looked_for_where_they_begin(spark):
    """A spelling of ten words adds no rows but where its first word stands; all runs against brute force."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    texts = [(i % 40, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)] + [(None, "w1 w2"), (7, None)]
    df = spark.createDataFrame(texts, "id int, t string")
    names = {" ".join(rng.choices(words, k=k)) for k in (1, 1, 2, 2, 2, 3, 3, 4) for _ in range(4)}
    names |= {" ".join(texts[3][1].split()[:10])}
    want = {(i, n) for i, t in texts for n in names if f" {n} " in f" {t or ''} "}
    table = extract.alias_frame(df, [{n: n for n in names}])
    joined = extract.gazetteer_join(df, table, id_col="id", text_col="t").collect()
    assert {(r.id, r.skill) for r in joined} == want and len(joined) == len(want)
    literal = df.select("id", F.explode(extract.gazetteer_skills("t", sorted(names))).alias("s")).distinct()
    assert {tuple(r) for r in literal.collect()} == want
    held = df.select(F.expr("uuid()").alias("_row"), extract.text_words("t").alias("words"))
    ten = extract.alias_frame(df, [{"w3 " + " ".join("abcdefghi"): "x"}])
    assert extract.spelling_starts(held, ten).count() == sum((t or "").split().count("w3") for _, t in texts)


def test_whole_texts_are_read_once_and_changed_where_needed(spark):
    """Texts without odd white space are left alone; words need no step of their own after the pattern; both
    against plain Python, over every white space character and the ones beside it."""
    odd = [chr(c + d) for c in (0x20, 0x85, 0xA0, 0x1680, 0x200A, 0x2029, 0x202F, 0x205F, 0x3000, 0x1F600)
           for d in (-1, 0, 1)] + ["\t", "\n", "\x1c", "-", ".", "+", "a", " ", " "]
    rng = random.Random(5)
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "a plain text, é", None]], "t string")
    rows = df.select("t", X.collapse_spaces("t").alias("c"), extract.text_words("t").alias("w"),
                     F.regexp_count("t", F.lit(X.UNEVEN_SPACE)).alias("n")).collect()
    for r in rows[:-1]:
        runs = re.findall(r"\s+", r.t)
        assert r.c == re.sub(r"\s+", " ", r.t) and r.n == sum(run != " " for run in runs)
        words = (w.strip("./-") for w in re.split(r"[^\w+#./-]+", r.t.lower()))
        assert r.w == [w for w in words if w]
    assert tuple(rows[-1]) == (None, None, None, None)
    plan = df.select(extract.text_words("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_a_batch_writes_its_new_rows_once(spark, tmp_path, monkeypatch):
    """Between the built rows and the table, no rows with all their columns are written."""
    written = []
    monkeypatch.setattr("skilltide.streaming.ingest.cut_lineage",
                        lambda df: written.append(df.columns) or cut_lineage(df))
    rows = frame(spark, raw(), raw(), raw(company="Other", job_url="https://x/2")).withColumn(
        "source_file", F.lit("f")).withColumn("_corrupt_record", F.lit(None).cast("string"))
    for _ in range(2):
        ingest_batch(rows, 0, table=f"{tmp_path}/t", dead_letters=f"{tmp_path}/d", key_buckets=2)
        assert tables.read_batches(spark, f"{tmp_path}/t").count() == 2
    assert sum("title_embedding" in columns for columns in written) == 2


def test_large_vocabularies_and_long_spellings(spark):
    five = "the very long skill name"
    text = f"We use {five.title()}, Go and Python."
    df = frame(spark, raw(job_description=text), raw(job_description=None))
    names = ["go", "python", five]
    canonical = {five: "five", "go": "golang"}
    capitals = {"golang": "Go", "five": "Five"}
    small = build_postings(df, spellings=names, canonical=canonical, capitalization=capitals)
    filler = [f"filler {i}" for i in range(20_000)]
    large = build_postings(df, spellings=names + filler, canonical=canonical | dict.fromkeys(filler, "x"),
                           capitalization=capitals)
    want = [["Five", "Go", "python"], []]
    for built in (small, large):
        assert [r.skills for r in built.orderBy(F.size("skills").desc()).collect()] == want
        assert built.columns[:len(COLUMNS)] == COLUMNS


PAGE = """<html><body><h1 class="x top-card-layout__title y"> Data &amp; AI <b>no</b></h1>
<a class="topcard__org-name-link" href="/c"> Acme </a>
<div class="show-more-less-html__markup z">One<br>two <ul><li>three</li><li> </li></ul><!-- c -->four
<div class="show-more-less-html__markup">five</div></div><div>six</div></body></html>"""
LIST = """<ul class="a jobs-search__results-list"><li><a class="base-card__full-link q"
 href=" https://x/1 ">a</a><a class="other" href="/no">b</a></li><li><a class="base-card__full-link"
 href=" ">c</a><a class="base-card__full-link" href="/2">d</a></li></ul>
<a class="base-card__full-link" href="/outside">e</a>"""


def test_pages(spark):
    df = spark.createDataFrame([("u1", PAGE), ("u2", "<h1 class='top-card-layout__title'>T</h1>"),
                                ("u3", LIST), ("u4", None)], "url string, html string")
    rows = {r.url: r for r in pages.page_fields(df).collect()}
    assert (rows["u1"].job_title, rows["u1"].company) == ("Data & AI", "Acme")
    assert rows["u1"].job_description == "One two three four five"
    assert rows["u1"].error is None and rows["u2"].company is None
    assert {rows[u].error for u in ("u2", "u3", "u4")} == {"missing title or description"}
    links = pages.page_links(df).orderBy("place").collect()
    assert [(r.url, r.link) for r in links] == [("u3", "https://x/1"), ("u3", "/2")]
    scraped = raw_from_pages(df, F.lit("2026-03-04").cast("date"))
    good, dead = split_failures(scraped)
    assert good.first().asDict() == {
        "job_title": "Data & AI", "company": "Acme", "job_url": "u1", "posted_date": "2026-03-04",
        "job_description": "One two three four five"} and dead.count() == 3
    codes = spark.createDataFrame([(404,), (410,), (200,), (500,)], "s int")
    assert [r[0] for r in codes.select(pages.fetch_outcome("s")).collect()] == [
        "drop", "drop", "ok", "retry"]


def put(folder, name, row):
    (folder / name).write_text(row if isinstance(row, str) else json.dumps(row), encoding="utf-8")


def test_read_and_archive(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "a.json", raw())
    put(inbox, "b.json", "{broken")
    put(inbox, "c.txt", "ignored")
    good, bad = postings.split_readable(postings.read_postings(spark, str(inbox)).cache())
    assert good.count() == 1 and bad.count() == 1
    postings.write_postings(good, str(tmp_path / "out"))
    again = spark.read.schema(schemas.RAW_POSTING).json(str(tmp_path / "out")).first()
    assert again.job_title == "Senior Backend Engineer" and again.posted_date == "2026-01-15"
    name = good.select(postings.archive_name("job_title", "company", F.to_date("posted_date")))
    assert name.first()[0] == "senior_backend_engineer_acme_20260115"


def run(spark, tmp_path, **options):
    query = start_ingest(spark, str(tmp_path / "in"), table=str(tmp_path / "table"),
                         dead_letters=str(tmp_path / "dead"), checkpoint=str(tmp_path / "cp"),
                         **options)
    query.awaitTermination()
    return tables.read_batches(spark, str(tmp_path / "table"))


def test_stream_ingest(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "a.json", raw())
    put(inbox, "b.json", raw(job_url=URL + "&again"))
    put(inbox, "c.json", raw(job_url="https://x/y", company="ACME "))
    put(inbox, "d.json", raw(job_url="https://x/z", job_description="Other. Rust."))
    put(inbox, "e.json", "{broken")
    put(inbox, "f.json", raw(job_url="https://x/q", posted_date="soon", job_title="Q"))
    dimension = spark.createDataFrame([("Senior Backend Engineer", "backend engineer")],
                                      "job_title string, canonical_title string")
    table = run(spark, tmp_path, read_dimension=lambda s: dimension,
                attach=lambda rows, d: rows.join(F.broadcast(d), "job_title", "left"))
    assert table.count() == 2             # b has the id of a, c has the content of a
    assert {r.canonical_title for r in table.collect()} == {"backend engineer"}
    dead = tables.read_batches(spark, str(tmp_path / "dead")).collect()
    assert sorted(r.error for r in dead) == ["bad posted_date", "unreadable"]
    put(inbox, "g.json", raw(job_url="https://x/w", job_description="New. Java."))
    put(inbox, "h.json", raw())
    assert run(spark, tmp_path).count() == 3
    # A replay of the last batch replaces its own attempt.
    again = spark.read.schema(postings.READ_SCHEMA).json(str(inbox / "g.json")).withColumn(
        "source_file", F.lit("g"))
    ingest_batch(again, 1, table=str(tmp_path / "table"), dead_letters=str(tmp_path / "dead"))
    assert tables.read_batches(spark, str(tmp_path / "table")).count() == 3


def test_key_index_reads_only_what_a_batch_needs(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"), 32)
    shape = "posting_id string, content_hash string"

    def rows(low, high):
        return spark.createDataFrame([(f"p{i}", f"h{i}" if i % 5 else None) for i in range(low, high)], shape)

    assert not index.exists() and index.stored(rows(0, 3)) is None
    for batch in range(6):
        index.add(rows(100 * batch, 100 * batch + 100), batch)
        found = index.stored(rows(7, 8))
        assert len(found.inputFiles()) <= 2 * (batch + 1)  # two buckets, however many rows
        assert found.filter("posting_id = 'p7'").count() == 1 == found.filter("content_hash = 'h7'").count()
    index.add(rows(0, 10), 5)  # a repeated attempt replaces the earlier one
    assert index.stored(rows(555, 556)) is None or index.stored(rows(555, 556)).filter(
        "posting_id = 'p555'").count() == 0
    assert index.stored(rows(7, 8), besides=0).filter("posting_id = 'p7'").count() == 1
    for before in (3, 3, 5):
        index.merge(before)
        assert len(index.stored(rows(7, 8)).inputFiles()) <= 2 * (7 - before)
    everything = index.stored(rows(0, 600))
    assert {r[0] for r in everything.select("posting_id").dropna().collect()} == {f"p{i}" for i in range(500)}
    assert everything.select("content_hash").dropna().count() >= 400


def test_pinned_snapshot(spark, tmp_path):
    root, pins = str(tmp_path / "titles"), str(tmp_path / "pins")
    assert tables.pinned_snapshot(spark, root, pins, 0) is None
    tables.write_snapshot(spark.range(1), root)
    assert tables.pinned_snapshot(spark, root, pins, 0).count() == 1
    tables.write_snapshot(spark.range(2), root)
    assert tables.pinned_snapshot(spark, root, pins, 0).count() == 1
    assert tables.pinned_snapshot(spark, root, pins, 1).count() == 2


def test_stream_sees_the_pinned_dimension(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "titles")
    inbox.mkdir()

    def attach(rows, d):
        return rows.join(d, "job_title", "left")

    shape = "job_title string, canonical_title string"
    tables.write_snapshot(spark.createDataFrame([("Senior Backend Engineer", "one")], shape), root)
    put(inbox, "a.json", raw())
    assert [r.canonical_title for r in run(spark, tmp_path, dimension=root, attach=attach).collect()] == ["one"]
    tables.write_snapshot(spark.createDataFrame([("Senior Backend Engineer", "two")], shape), root)
    put(inbox, "b.json", raw(job_url="https://x/w", job_description="New. Java."))
    rows = run(spark, tmp_path, dimension=root, attach=attach)
    assert sorted(r.canonical_title for r in rows.collect()) == ["one", "two"]


def test_table_without_an_index(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "a.json", raw())
    first = run(spark, tmp_path)
    tables.write_batch(first, str(tmp_path / "copy"), 0)
    again = spark.read.schema(postings.READ_SCHEMA).json(str(inbox / "a.json")).withColumn(
        "source_file", F.lit("g"))
    ingest_batch(again, 1, table=str(tmp_path / "copy"), dead_letters=str(tmp_path / "dead2"))
    assert tables.read_batches(spark, str(tmp_path / "copy")).count() == 1


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "catalog")
    assert tables.read_snapshot(spark, root) is None
    tables.write_snapshot(spark.range(3), root)
    tables.write_snapshot(tables.read_snapshot(spark, root).filter("id > 0"), root)
    assert tables.read_snapshot(spark, root).count() == 2


def test_seeds(spark):
    assert tables.seed_families(spark).count() == 12 and tables.seed_specs(spark).count() == 25
    canonical, capitals = tables.alias_tables(spark)
    assert canonical.union(capitals).select("spelling").distinct().count() == 169
    with pytest.raises(ValueError, match="missing"):
        schemas.require_columns(tables.seed_specs(spark), "content_hash")


def test_catalog_and_profile(spark):
    df = spark.createDataFrame([(str(i), ["a", "b", "c"] if i % 2 else []) for i in range(60)],
                               "posting_id string, skills array<string>")
    rows = build_catalog(df)
    first = rows.first()
    assert first.support_count == 30 and first.skills == ["a", "b", "c"]
    assert {f.name for f in schemas.PROJECT.fields} == set(rows.columns)
    assert build_catalog(df, rows).count() == 1
    profile = report.corpus_profile(df).first()
    assert (profile.postings, profile.avg_skills) == (60, 3)
    assert mining.build_baskets(df).count() == 30


def test_gazetteer_moves_no_text(spark):
    """Places of a small vocabulary are not shuffled, and the texts are in none; spellings of one to eight
    words, cut off at the end of a text, under ids that repeat."""
    words = ["a", "b", "c", "d"]
    rng = random.Random(8)
    texts = [(i % 15, " ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(40)]
    df = spark.createDataFrame(texts, "id int, t string")
    for longest in (1, 4, 5, 8):
        names = {" ".join(rng.choices(words, k=k)) for k in range(1, longest + 1) for _ in range(3)}
        want = {(i, n) for i, t in texts for n in names if f" {n} " in f" {t} "}
        got = extract.gazetteer_join(df, extract.alias_frame(df, [{n: n for n in names}]), id_col="id", text_col="t")
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        if longest <= extract.CARRIED + 1:
            plan = got._jdf.queryExecution().sparkPlan().toString()
            assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
