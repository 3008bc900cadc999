import hashlib
import itertools
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skilltide.functions.text import trigram_similarity
from skilltide.operators import keys, mining, recommend, report, retrieval, scale, similarity
from skilltide.operators.vector_search import vector_search
from skilltide.operators import vector_join as join_module
from skilltide.operators import vector_search as vector_module

WORDS = "back end backend software engineer front data scientist senior ml cloud web".split()


def grams(text):
    out = set()
    for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        padded = f"  {word} "
        out |= {padded[i:i + 3] for i in range(len(padded) - 2)}
    return out


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def titles(seed, n):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        text = " ".join(rng.choices(WORDS, k=rng.randint(1, 4)))
        if rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + text[at + 1:]
        out.add(text)
    return sorted(out)


def strings(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("threshold,common", [(0.3, 64), (0.3, 0), (0.55, 8), (2 / 3, 64), (1.0, 5)])
def test_trigram_pairs_are_exact(spark, threshold, common):
    left, right = titles(1, 40), titles(2, 60)
    got = similarity.trigram_pairs(strings(spark, left, "a"), strings(spark, right + right, "b"),
                                   "a", "b", threshold=threshold, common_tokens=common).collect()
    want = {(a, b): jaccard(a, b) for a in left for b in right if jaccard(a, b) >= threshold}
    assert len(got) == len(want)
    assert {(r.left_text, r.right_text): r.similarity for r in got} == pytest.approx(want)


def test_trigram_self_pairs(spark):
    texts = titles(3, 50)
    df = strings(spark, texts, "t")
    got = similarity.trigram_pairs(df, df, "t", "t", threshold=0.6, less_than=True).collect()
    want = {(a, b) for a, b in itertools.combinations(texts, 2) if jaccard(a, b) >= 0.6}
    assert {(r.left_text, r.right_text) for r in got} == want and len(got) == len(want)


def test_cut_lineage_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffled():
        return {name for folder in folders for _, _, names in os.walk(folder.getPath())
                for name in names if name.startswith("shuffle_")}

    before, conf = shuffled(), spark.conf.get(scale.CLEAN_UP, None)
    rows = scale.cut_lineage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert rows.count() == 100 and spark.conf.get(scale.CLEAN_UP, None) == conf


@pytest.mark.parametrize("same", [True, False])
def test_trigram_pairs_of_texts_alike_are_not_shuffled(spark, monkeypatch, same):
    """Long texts of few words: the index would join more rows than there are pairs."""
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", 16)
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcde"), 4)) for _ in range(40)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 30)))) for _ in range(120)]
    df = strings(spark, [*texts, texts[0], "-", None], "t")
    other = df if same else strings(spark, texts[:50], "u")
    found = similarity.trigram_pairs(df, other, "t", "t" if same else "u", threshold=0.5, less_than=same,
                                     label=F.md5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "MapInArrow" in plan
    names = {t: hashlib.md5(t.encode()).hexdigest() for t in texts}
    pairs = itertools.combinations(set(texts), 2) if same else itertools.product(set(texts), set(texts[:50]))
    want = {tuple(sorted((names[a], names[b])) if same else (names[a], names[b])): jaccard(a, b)
            for a, b in pairs if jaccard(a, b) >= 0.5}
    got = found.collect()
    assert len(want) > 100 and len(got) == len(want)
    assert {(r.left_text, r.right_text): r.similarity for r in got} == pytest.approx(want)


@pytest.mark.parametrize("same", [True, False])
def test_trigram_pairs_of_texts_alike_meet_without_a_cross_join(spark, monkeypatch, same):
    """Groups of blocks are broadcast one by one; common trigrams are multiplied, rare ones counted."""
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", 16)
    monkeypatch.setattr(similarity, "GROUP_BYTES", 4096)
    monkeypatch.setattr(similarity, "BLOCK_GRAMS", 16)
    monkeypatch.setattr(similarity, "SPARSE_PAIRS", 100)
    monkeypatch.setattr(similarity, "SPARSE", 4)
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcde"), 4)) for _ in range(40)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 30)))) for _ in range(120)]
    df = strings(spark, [*texts, texts[0], "-", None], "t")
    other = df if same else strings(spark, [*texts[:50], " "], "u")
    found = similarity.trigram_pairs(df, other, "t", "t" if same else "u", threshold=0.5, less_than=same)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and plan.count("MapInArrow") > 2
    pairs = itertools.combinations(sorted(set(texts)), 2) if same else itertools.product(set(texts), set(texts[:50]))
    want = {(a, b): jaccard(a, b) for a, b in pairs if jaccard(a, b) >= 0.5}
    got = found.collect()
    assert len(want) > 100 and len(got) == len(want)
    assert {(r.left_text, r.right_text): r.similarity for r in got} == pytest.approx(want)
    assert similarity.trigram_pairs(df.limit(0), df.limit(0), "t", "t", threshold=0.5).count() == 0


def test_trigram_index_order(spark):
    """Rare trigrams first, each with its own token; the common ones follow by their frequency."""
    df = strings(spark, ["abc abd", "abc abe", "abc xyz q"], "t")
    texts = similarity._distinct_texts(df, "t")
    common = similarity._common_tokens(texts, 3)
    rows = similarity._index(texts, 0.01, common).collect()
    sets = {r.id: set(r.grams) for r in texts.collect()}
    assert {i: len({r.token for r in rows if r.id == i}) for i in sets} == {i: len(g) for i, g in sets.items()}
    assert len({r.token for r in rows}) == len(set.union(*sets.values()))
    assert {r.rest for r in rows} == {0} and {r.last.c for r in rows} == {3}


def test_trigram_candidates_stay_near_the_results(spark, sf_dir):
    """Whole texts at the lowest gate: nearly all texts of a language share some trigram."""
    from skilltide.functions.text import title_key
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        title_key("text", rules=()).alias("t"))
    texts = similarity._distinct_texts(docs, "t")
    common = similarity._common_tokens(texts, 64)
    pairs = similarity.candidate_pairs(texts, texts, 0.3, common, same=True).count()
    sets = [grams(r.text) for r in texts.select("text").collect()]
    results = sum(len(a & b) >= 0.3 * len(a | b) for a, b in itertools.combinations(sets, 2))
    assert 0 < results <= pairs < 1.5 * results


def corpus(spark, n=400, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    levels = ["senior", "unknown", "intern", None]
    rows = []
    for i in range(n):
        vector = None if i % 17 == 0 else [float(x) for x in np.round(base[i % len(base)], 6)]
        rows.append((f"p{i:04d}", vector, levels[i % 4], None if i % 5 == 0 else 2020 + i % 6))
    schema = "posting_id string, title_embedding array<double>, seniority string, posting_year int"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def cos(a, b):
    return round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)


def brute_vectors(rows, queries, k=None, floor=None):
    want = {}
    for query_id, vector, level, year in queries:
        found = []
        for pid, v, s, y in rows:
            if v is None or (level is not None and s not in (level, "unknown")):
                continue
            if year is not None and (y is None or y < year):
                continue
            score = cos(v, vector)
            if floor is None or score > floor:
                found.append((-score, pid))
        want[query_id] = [p for _, p in sorted(found)[:k]]
    return want


@pytest.mark.parametrize("k,floor,cells", [(7, None, 4_000_000), (7, None, 16), (50, 0.2, 4_000_000),
                                           (None, 0.6, 24)])
def test_vector_search_is_exact(spark, monkeypatch, k, floor, cells):
    monkeypatch.setattr(vector_module, "MAX_BLOCK_CELLS", cells)
    monkeypatch.setattr(vector_module, "TILE_ROWS", 64)
    monkeypatch.setattr(vector_module, "TILE_QUERIES", 3)
    rows, df = corpus(spark)
    rng = np.random.default_rng(9)
    queries = [(i, [float(x) for x in np.round(rng.normal(size=8), 6)],
                [None, "senior", "intern"][i % 3], [None, 2023][i % 2]) for i in range(6)]
    queries.append((6, rows[1][1], None, None))
    asked = spark.createDataFrame(
        queries, "query_id int, query_vector array<double>, seniority_filter string, year_floor int")
    got = vector_search(df, asked, dim=8, k=k, floor=floor).collect()
    want = brute_vectors(rows, queries, k, floor)
    for query_id, ids in want.items():
        mine = sorted((-r.score, r.posting_id) for r in got if r.query_id == query_id)
        assert [p for _, p in mine] == ids
    assert len(got) == sum(map(len, want.values()))


def test_top_k_and_rank(spark):
    rows = [(i % 2 if i < 300 else 7, (i * 37) % 101, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(6)
    got = scale.top_k_per_group(df, ["g"], [F.desc("v"), F.asc("i")], 25, spread_on=["i"])
    for g in (0, 1, 7):
        want = sorted((-v, i) for gg, v, i in rows if gg == g)[:25]
        assert sorted((-r.v, r.i) for r in got.filter(F.col("g") == g).collect()) == want
    ranked = scale.ranked_in_group(df.withColumn("n", F.when(F.col("g") != 0, F.col("g"))),
                                   ["n"], "i", rows_per_range=50).collect()
    for g in (None, 1, 7):
        mine = sorted((r.i, r["rank"]) for r in ranked if r.n == g)
        assert [k for _, k in mine] == list(range(1, len(mine) + 1))
    assert len(ranked) == 900


@pytest.mark.parametrize("k,floor,tile", [(7, None, 16), (60, 0.2, 32), (None, 0.6, 8), (3, None, 4096)])
def test_vector_join_is_exact(spark, monkeypatch, k, floor, tile):
    for name, value in (("TILE_ROWS", tile), ("TILE_QUERIES", 3), ("TILES_PER_KEY", 2)):
        monkeypatch.setattr(join_module, name, value)
    rows, df = corpus(spark)
    rows += [(f"same{i:03d}", rows[1][1], "unknown", 2024) for i in range(200)]  # a hot cluster of ties
    rows.append(("zero", [0.0] * 8, "unknown", 2024))
    df = spark.createDataFrame(rows, df.schema).repartition(5)
    rng = np.random.default_rng(9)
    queries = [(i, [float(x) for x in np.round(rng.normal(size=8), 6)],
                [None, "senior", "intern"][i % 3], [None, 2023][i % 2]) for i in range(9)]
    queries += [(20, rows[1][1], None, None), (21, rows[1][1], "senior", 2030)]
    asked = spark.createDataFrame(
        queries, "query_id int, query_vector array<double>, seniority_filter string, year_floor int")
    got = join_module.vector_join(df, asked, dim=8, k=k, floor=floor).collect()
    want = brute_vectors([r for r in rows if r[0] != "zero"], queries, k, floor)
    for query_id, ids in want.items():
        mine = sorted((-r.score, r.posting_id) for r in got if r.query_id == query_id)
        assert [p for _, p in mine] == ids
    assert len(got) == sum(map(len, want.values()))


def test_vector_join_skips_clusters_and_empty_sides(spark, monkeypatch):
    monkeypatch.setattr(join_module, "TILE_ROWS", 20)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centers[i % 20] + rng.normal(size=16) * 0.02]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id int, v array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_vector"))
    sent, routed = [], join_module._routed
    monkeypatch.setattr(join_module, "_routed", lambda *a: sent.append(cut(routed(*a))) or sent[-1])
    cut = scale.cut_lineage
    got = join_module.vector_join(df, asked, dim=16, k=5, id_col="vec_id", vector_col="v", faceted=False)
    mine = {(r.query_id, r.posting_id) for r in got.collect()}
    m = np.round(np.array([v for _, v in rows]), 6)
    scores = np.round((m / np.linalg.norm(m, axis=1)[:, None]) @ (m / np.linalg.norm(m, axis=1)[:, None]).T, 9)
    for q in range(800):
        best = sorted(range(800), key=lambda i: (-scores[q, i], i))[:5]
        assert all((q, i) in mine for i in best)
    pairs = sum(s.select(F.size("q_id").alias("n")).agg(F.sum("n")).first()[0] or 0 for s in sent)
    assert len(mine) == 4000 and pairs < 800 * 6  # of 40 clusters each
    none = df.limit(0)
    for a, b in ((none, asked), (df, asked.limit(0))):
        assert join_module.vector_join(a, b, dim=16, k=5, id_col="vec_id", vector_col="v",
                                       faceted=False).count() == 0


@pytest.mark.parametrize(("k", "floor", "faceted"), [(5, None, False), (3, 0.1, True), (None, 0.3, True)])
def test_vector_join_does_not_send_tiles_to_every_cluster(spark, monkeypatch, k, floor, faceted):
    """Vectors without clusters: all must be compared with all. Some come twice, some have no length."""
    for name, value in (("TILE_ROWS", 30), ("TILE_QUERIES", 16), ("GROUP_BYTES", 60 * 8 * 12), ("STRIP", 8),
                        ("PAIR_BYTES", 800)):
        monkeypatch.setattr(join_module, name, value)
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in np.round(rng.normal(size=12), 6)] for _ in range(240)]
    vectors += vectors[:40] + [[0.0] * 12]
    levels, years = ["senior", "intern", "unknown", None], [2021, 2024, None]
    rows = [(f"p{i % 270:03d}" if i else None, v, levels[i % 4], years[i % 3]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(
        rows, "posting_id string, title_embedding array<double>, seniority string, posting_year int")
    asks = [(i, v, [None, "senior"][i % 2], [None, 2023][i // 2 % 2]) for i, v in enumerate(vectors[:90])]
    asked = spark.createDataFrame(
        asks, "query_id int, query_vector array<double>, seniority_filter string, year_floor int")
    found = join_module.vector_join(df, asked, dim=12, k=k, floor=floor, faceted=faceted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan and plan.count("MapInArrow") > 2
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((-r.score, r.posting_id or ""))
    for query_id, v, level, year in asks:
        want = []
        for id_, w, own, since in rows:
            if faceted and (level and own not in (level, "unknown") or year and (since is None or since < year)):
                continue
            if any(w):
                score = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9)
                want += [(-score, id_ or "")] if floor is None or score > floor else []
        want = sorted(want)[:k]
        mine = sorted(got.get(query_id, []))
        assert [i for _, i in mine] == [i for _, i in want]
        assert [s for s, _ in mine] == pytest.approx([s for s, _ in want], abs=2e-9)


POSTINGS = "posting_id string, job_title string, skills array<string>, seniority string, " \
           "posting_year int, title_embedding array<double>"


def postings(spark, n=300, seed=11):
    rng = random.Random(seed)
    names = titles(seed, 12)
    vectors = {t: [rng.gauss(0, 1) for _ in range(6)] for t in names}
    rows = []
    for i in range(n):
        title = rng.choice(names)
        vector = [round(x + rng.gauss(0, 0.2), 6) for x in vectors[title]]
        rows.append((f"p{i:04d}", title, rng.sample(WORDS, rng.randint(0, 5)),
                     rng.choice(["senior", "unknown", None]), rng.choice([None, 2024, 2026]),
                     None if i % 23 == 0 else vector))
    queries = [(i, names[i], [round(x, 6) for x in vectors[names[i]]],
                [None, "senior"][i % 2], [None, 2025][i // 2 % 2]) for i in range(6)]
    shape = "query_id int, query_text string, query_vector array<double>, " \
            "seniority_filter string, year_floor int"
    return rows, queries, spark.createDataFrame(rows, POSTINGS), spark.createDataFrame(queries, shape)


def brute_hybrid(rows, queries, s):
    out = {}
    for query_id, text, vector, level, year in queries:
        ok = [r for r in rows if (level is None or r[3] in (level, "unknown"))
              and (year is None or (r[4] is not None and r[4] >= year))]
        sem = sorted((-cos(r[5], vector), r[0]) for r in ok if r[5])[:s.semantic_pool]
        lex = sorted((-jaccard(r[1], text), r[0]) for r in ok
                     if jaccard(r[1], text) >= s.similarity_gate)[:s.lexical_pool]
        sem, lex = {p: -c for c, p in sem}, {p: -c for c, p in lex}
        for p in {*sem, *lex}:
            score = round(s.vector_weight * sem.get(p, 0) + s.trigram_weight * lex.get(p, 0), 9)
            if score > s.floor:
                out[query_id, p] = score
    return out


@pytest.mark.parametrize("settings", [
    retrieval.HybridSettings(), retrieval.HybridSettings(20, 15),
    retrieval.HybridSettings(20, 15, 2000, 0.5, 0.5, 0.4),
    retrieval.HybridSettings(40, 40, 30, 0.4, 0.6, 0.2)])
def test_hybrid_match(spark, settings):
    rows, queries, df, asked = postings(spark)
    want = brute_hybrid(rows, queries, settings)
    if settings.match_limit < settings.semantic_pool + settings.lexical_pool:
        keep = {}
        for (q, p), s in want.items():
            keep.setdefault(q, []).append((-s, p))
        want = {(q, p): -s for q, v in keep.items() for s, p in sorted(v)[:settings.match_limit]}
    for prune in (True, False):
        got = retrieval.hybrid_match(df, asked, dim=6, settings=settings, prune=prune).collect()
        assert {(r.query_id, r.posting_id): r.combined for r in got} == pytest.approx(want)
        assert len(got) == len(want) > 0


def test_structured_match(spark):
    rows = [("a", "t1", ["x"], "senior", 2026, "eng", ["backend", "web"], [1.0, 0.0]),
            ("b", "t2", [], "unknown", 2026, "eng", ["backend"], None),
            ("c", "t3", ["y"], "intern", 2026, "eng", ["backend"], None),
            ("d", "t4", ["y"], None, 2026, "eng", ["backend"], None),
            ("e", "t5", ["y"], "senior", None, "eng", ["backend"], None),
            ("f", "t6", ["y"], "senior", 2026, "eng", [], None),
            ("g", "t7", ["y"], "senior", 2026, None, [], [1.0, 0.1]),
            ("h", "t8", ["y"], "senior", 2026, None, [], [0.0, 1.0]),
            ("i", "t9", ["y"], "senior", 2026, None, [], [1.0, 0.2])]
    df = spark.createDataFrame(rows, "posting_id string, job_title string, skills array<string>, "
                               "seniority string, posting_year int, role_family string, "
                               "specializations array<string>, title_embedding array<double>")
    df = df.withColumn("canonical_title", F.lit(None).cast("string"))
    asked = spark.createDataFrame(
        [(1, "eng", ["backend"], "senior", 2025, [1.0, 0.0]), (2, "eng", [], None, None, [1.0, 0.0])],
        "query_id int, role_family string, specializations array<string>, seniority_filter string, "
        "year_floor int, query_vector array<double>")
    got = retrieval.structured_match(df, asked, dim=2,
                                     settings=retrieval.RecallSettings(0.86, 1)).collect()
    found = {q: sorted(r.posting_id for r in got if r.query_id == q) for q in (1, 2)}
    assert found == {1: ["a", "b", "g"], 2: ["a", "b", "c", "d", "e", "f", "g"]}


def test_skill_report(spark):
    rows = [(1, "a", "T1", ["x", "y", "x"]), (1, "b", "T1", ["x"]), (1, "c", "T2", []),
            (2, "d", "T3", [])]
    matched = spark.createDataFrame(
        rows, "query_id int, posting_id string, job_title string, skills array<string>")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r.query_id: r for r in report.skill_report(
        report.match_facts(matched), asked).collect()}
    assert (got[1].job_count, got[1].skills_count) == (3, 2)
    assert [(s.name, s["count"], s.percentage) for s in got[1].skills] == [
        ("x", 3, 100.0), ("y", 1, pytest.approx(33.33))]
    assert got[1].related_titles == ["T1", "T2"]
    # A match without any skill reports no postings, though it has a related title.
    assert (got[2].job_count, got[2].skills, got[2].related_titles) == (0, None, ["T3"])
    assert (got[3].job_count, got[3].skills_count) == (0, 0)
    facts = report.match_facts(matched)
    assert [(r.skill, r.cnt) for r in report.all_skills(facts).collect()] == [("x", 3), ("y", 1)]
    bars = report.demand_bars(report.top_skills(facts)).orderBy("rank").collect()
    assert [(b.shown_pct, round(b.bar, 2)) for b in bars] == [(100, 100.0), (33, 33.33)]


@pytest.mark.parametrize("part,whole,pct", [(1, 8, 12.5), (1, 3, 33.33), (1, 16, 6.25),
                                            (5, 1000, 0.5), (1, 800, 0.13), (3, 800, 0.38), (1, 0, None)])
def test_percentage_rounds_halves_up(spark, part, whole, pct):
    df = spark.createDataFrame([(part, whole)], "a bigint, b bigint")
    assert df.select(report.percentage(F.col("a"), F.col("b"))).first()[0] == pct


def baskets(seed=3, n=400):
    rng = random.Random(seed)
    items = [f"s{i:02d}" for i in range(14)]
    weights = [1 / (i + 1) for i in range(14)]
    return [(f"b{i}", [x if rng.random() > 0.02 else None
                       for x in rng.choices(items, weights, k=rng.randint(0, 9))])
            for i in range(n)]


def brute_triples(rows, min_support, min_lift, cap):
    sets = [sorted({x for x in items[:cap] if x is not None}) for _, items in rows if len(items) >= 3]
    n, single, triple = len(sets), {}, {}
    for s in sets:
        for x in s:
            single[x] = single.get(x, 0) + 1
        for t in itertools.combinations(s, 3):
            triple[t] = triple.get(t, 0) + 1
    return {t: (c, c * n * n / math.prod(single[x] for x in t)) for t, c in triple.items()
            if c >= min_support and c * n * n >= min_lift * math.prod(single[x] for x in t)}


@pytest.mark.parametrize("prune,literal,cap", [(True, 5000, 30), (True, 3, 30), (False, 5000, 4)])
def test_triples(spark, monkeypatch, prune, literal, cap):
    monkeypatch.setattr(mining, "MAX_LITERAL_ITEMS", literal)
    rows = baskets()
    df = spark.createDataFrame(rows, "posting_id string, skills array<string>")
    got = mining.mine_triples(df, min_support=5, min_lift=1.0, top_n=None, max_skills=cap,
                              prune=prune).collect()
    want = brute_triples(rows, 5, 1.0, cap)
    assert {(r.s1, r.s2, r.s3): (r.support_count, pytest.approx(r.lift)) for r in got} == want
    top = mining.mine_triples(df, min_support=5, top_n=5, max_skills=cap, prune=prune).collect()
    order = sorted(want, key=lambda t: (-want[t][0], t))[:5]
    assert [(r.s1, r.s2, r.s3) for r in top] == order


def test_lift_of_exactly_one_is_kept(spark):
    rows = [(str(i), ["a", "b", "c"]) for i in range(30)]
    df = spark.createDataFrame(rows, "posting_id string, skills array<string>")
    assert mining.mine_triples(df, min_support=25).first().lift == 1.0


def brute_cover(top, catalog):
    top = top[:5]
    if len(top) < 3:
        return []
    cands = sorted((c for c in catalog if set(c[1]) <= set(top)), key=lambda c: (-c[2], c[0]))
    covered, picked = set(), []
    while len(picked) < 4 and len(picked) < len(cands):
        gain, best = -1, None
        for c in cands:
            if c not in picked and len(set(c[1]) - covered) > gain:
                gain, best = len(set(c[1]) - covered), c
        if gain == 0 and len(picked) >= 3:
            break
        picked.append(best)
        covered |= set(best[1])
        if len(covered) >= len(top) and len(picked) >= 3:
            break
    return [c[0] for c in picked]


def test_recommend_equals_greedy_cover(spark):
    rng = random.Random(8)
    names = list("ABCDEFg")
    catalog = [(f"id{i:03d}", tuple(rng.sample(names, 3)), float(rng.randint(1, 9)))
               for i in range(60)]
    frame = spark.createDataFrame(
        [(i, "t", "BEGINNER", "b", list(s), x) for i, s, x in catalog],
        "project_id string, title string, level string, blurb string, skills array<string>, score float")
    asked = [(i, [rng.choice(names) for _ in range(rng.randint(0, 7))]) for i in range(60)]
    asked += [(100, ["a", "b", "c"]), (101, list("ABCDE"))]
    requests = spark.createDataFrame(asked, "query_id int, skills array<string>")
    got = {r.query_id: [p.project_id for p in r.projects]
           for r in recommend.recommend(requests, frame).collect()}
    assert got == {q: brute_cover(s, catalog) for q, s in asked}


def test_subset_join_is_complete(spark):
    rng = random.Random(9)
    names = list("ABCDEFG")
    catalog = [(i, rng.sample(names, rng.randint(0, 6))) for i in range(150)]
    catalog += [(200 + i, ["B", "A"]) for i in range(9)] + [(300, None), (301, ["A", None])]
    asked = [(i, rng.sample(names, rng.randint(2, 7))) for i in range(20)]
    found = recommend.subset_join(
        spark.createDataFrame(asked, "query_id int, skills array<string>"),
        spark.createDataFrame([(i, s, 1.0) for i, s in catalog],
                              "project_id int, skills array<string>, score double"))
    want = {(q, i) for q, top in asked if len(top) >= 3 for i, s in catalog
            if s is not None and set(s) <= set(top[:5])}
    rows = [(r.query_id, r.project_id) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_top_k_beyond_the_group_limit(spark):
    df = spark.range(0, 9_000, 1, 6).select((F.col("id") % 2).alias("g"), F.hash("id").alias("v"), "id")
    order = [F.asc("v"), F.asc("id")]
    got = scale.top_k_per_group(df, ["g"], order, 2_000, spread_on=["id"])
    rows = sorted((r.g, r.v, r.id) for r in df.collect())
    want = [r for g in (0, 1) for r in [x for x in rows if x[0] == g][:2_000]]
    assert sorted((r.g, r.v, r.id) for r in got.collect()) == want and got.columns == df.columns


def test_catalog_rows(spark):
    import uuid
    triples = spark.createDataFrame([("React", "go", "AWS", 30, 1.5), ("x", "y", "z", 26, 1.0)],
                                    "s1 string, s2 string, s3 string, support_count long, lift double")

    def generator(skills):
        if "x" in skills:
            raise RuntimeError("model failed")
        return '{"title": " T ", "level": "expert", "blurb": "B"}'

    for rows in (recommend.catalog_rows(recommend.generate_projects(triples, generator)).collect(),):
        assert len(rows) == 1
        assert (rows[0].title, rows[0].level, rows[0].blurb) == ("T", "INTERMEDIATE", "B")
        assert rows[0].skills_key == "aws|go|react" and rows[0].score == 30.0
        assert rows[0].project_id == str(uuid.uuid5(
            uuid.UUID("6f8d2e4a-9c1b-4e7a-9b2f-1a3c5d7e9f01"), "aws|go|react"))
    assert recommend.catalog_rows(recommend.generate_projects(triples)).count() == 2
    lists = spark.createDataFrame([("a, b,,c",), ("  ",)], "t string")
    assert [r[0] for r in lists.select(recommend.parse_skill_list("t")).collect()] == [
        ["a", "b", "c"], None]


def sequential_insert(rows, stored=()):
    ids, hashes, out = {p for p, _ in stored}, {h for _, h in stored if h}, []
    for a, p, h in rows:
        ok = p not in ids and (h is None or h not in hashes)
        if ok:
            ids.add(p)
            hashes.add(h)
            out.append(a)
    return out


@pytest.mark.parametrize("rows", [
    [(1, "p1", "h1"), (2, "p2", "h1"), (3, "p2", "h3")],
    [(1, "p1", "h1"), (2, "p1", "h2"), (3, "p3", "h2")],
    [(1, "p1", None), (2, "p2", None), (3, "p1", None)]])
def test_double_key_cases(spark, rows):
    df = spark.createDataFrame(rows, "arrival int, posting_id string, content_hash string")
    got = keys.insert_rows(df).orderBy("arrival").collect()
    assert [r.arrival for r in got] == sequential_insert(rows)


def test_double_key_random_and_replay(spark):
    rng = random.Random(4)
    rows = [(i, f"p{rng.randint(0, 60)}", None if rng.random() < 0.1 else f"h{rng.randint(0, 60)}")
            for i in range(200)]
    stored = [(f"p{i}", f"h{i + 3}") for i in range(5)]
    shape = "arrival int, posting_id string, content_hash string"
    df = spark.createDataFrame(rows, shape).repartition(3)
    old = spark.createDataFrame(stored, "posting_id string, content_hash string")
    got = keys.insert_rows(df, old)
    assert sorted(r.arrival for r in got.collect()) == sequential_insert(rows, stored)
    table = old.unionByName(got.select("posting_id", "content_hash"))
    assert keys.insert_rows(df, table).count() == 0


@pytest.mark.parametrize("breaks", [0, 7])
def test_double_key_chains(spark, monkeypatch, breaks):
    """Each row shares its id with one neighbour and its hash with the other: few joins, not many."""
    n, tables = 3000, []
    rows = [(i, f"p{i // 2}", None if breaks and i % 97 == breaks else f"h{(i + 1) // 2}")
            for i in range(n)]
    df = spark.createDataFrame(rows, "arrival int, posting_id string, content_hash string")
    cut = keys.cut_lineage
    monkeypatch.setattr(keys, "cut_lineage", lambda frame: tables.append(1) or cut(frame))
    got = keys.insert_rows(df.repartition(3))
    assert sorted(r.arrival for r in got.collect()) == sequential_insert(rows)
    assert len(tables) < 30


@pytest.mark.parametrize("seed", range(4))
def test_double_key_tangles(spark, seed):
    """Few keys for many rows, so that rows wait for two others."""
    rng = random.Random(seed)
    rows = [(i, f"p{rng.randint(0, 25 + 10 * seed)}", f"h{rng.randint(0, 25 + 10 * seed)}")
            for i in range(300)]
    df = spark.createDataFrame(rows, "arrival int, posting_id string, content_hash string")
    assert sorted(r.arrival for r in keys.insert_rows(df).collect()) == sequential_insert(rows)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join(spark, how):
    """A key with a third of the rows, one that only this side has, and NULLs."""
    rows = [("hot" if i % 3 == 0 else None if i % 50 == 7 else f"k{i % 40}", i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k string, i int").repartition(5)
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k3", "c"), (None, "d")], "k string, v string")
    got = scale.salted_join(left, right, "k", how, spread_on=["i"])
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    hot = (scale.salted_join(left, right.hint("merge"), "k", how, spread_on=["i"]).filter("k = 'hot'")
           .groupBy(F.xxhash64("i") % 64).count().count())
    assert hot > 20


def test_running_sums(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 11}", i, rng.randrange(5)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = scale.running_sums(df, "g", ["i"], {"before": F.col("v"), "n": F.lit(1)}, rows_per_range=60)
    for r in got.collect():
        own = [v for g, i, v in rows if g == r.g and i < r.i]
        assert (r.before, r.n) == (sum(own), len(own))
    assert len(got.columns) == 5 and got.count() == 700


def test_hot_keys(spark):
    """A third of the rows share one id, another third one hash, and every title is the same."""
    n = 6000
    rows = [(i, "hot" if i % 3 == 0 else f"p{i // 2}", "hot" if i % 3 == 1 else f"h{i // 5}")
            for i in range(n)]
    df = spark.createDataFrame(rows, "arrival int, posting_id string, content_hash string")
    assert sorted(r.arrival for r in keys.insert_rows(df).collect()) == sequential_insert(rows)
    posts = spark.range(n).select(
        F.format_string("p%05d", "id").alias("posting_id"), F.lit("backend engineer").alias("job_title"),
        F.when(F.col("id") % 2 == 0, "senior").alias("seniority"),
        F.lit(None).cast("int").alias("posting_year"))
    asked = spark.createDataFrame([(1, "backend enginer", None), (2, "backend engineer", "senior")],
                                  "query_id int, query_text string, seniority_filter string")
    pool = retrieval.lexical_pool(posts, asked.withColumn("year_floor", F.lit(None).cast("int")),
                                  k=50).collect()
    got = {q: sorted(r.posting_id for r in pool if r.query_id == q) for q in (1, 2)}
    assert got == {1: [f"p{i:05d}" for i in range(50)], 2: [f"p{2 * i:05d}" for i in range(50)]}


def test_upsert_and_insert_absent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in keys.upsert(old, new, ["k"]).collect()) == [
        (1, "a"), (2, "c"), (3, "d")]
    late = spark.createDataFrame([(2, "z", 1), (3, "second", 9), (3, "first", 4)],
                                 "k int, v string, at int")
    assert sorted(tuple(r) for r in keys.insert_absent(old, late, ["k"], "at").collect()) == [
        (1, "a"), (2, "b"), (3, "first")]


def test_similarity_column_equals_join(spark):
    df = spark.createDataFrame(list(zip(titles(6, 20), titles(7, 20))), "a string, b string")
    for r in df.select("a", "b", trigram_similarity("a", "b").alias("s")).collect():
        assert r.s == pytest.approx(jaccard(r.a, r.b))


def test_triples_do_not_depend_on_the_join_of_frequent_items(spark, monkeypatch):
    from skilltide.operators import mining
    rows = [("x", ["a", "b", "c"]), ("x", ["a", "b", "c"]), ("y", ["a", "b", "c", "d"])]
    postings = spark.createDataFrame(rows, "posting_id string, skills array<string>")
    want = mining.mine_triples(postings, min_support=2).collect()
    monkeypatch.setattr(mining, "MAX_LITERAL_ITEMS", 0)
    assert mining.mine_triples(postings, min_support=2).collect() == want
    assert [(r["support_count"], r["lift"]) for r in want] == [(3, 1.0)]


def test_postings_without_skills_are_counted(spark):
    from skilltide.operators.report import match_facts
    rows = [(1, None, "t"), (1, [], "t"), (1, ["s"], "u")]
    matched = spark.createDataFrame(rows, "query_id int, skills array<string>, title string")
    facts = {(r["kind"], r["value"]): r["cnt"]
             for r in match_facts(matched, title="title").collect()}
    assert facts == {("skill", "s"): 1, ("title", "t"): 2, ("title", "u"): 1, ("all", None): 3}


@pytest.mark.parametrize(("query", "posting"), [([1.0], [1.0, 0.0]), ([1.0, 0.0], [1.0])])
def test_vectors_of_another_size_are_an_error(spark, query, posting):
    from skilltide.operators.vector_search import vector_search
    postings = spark.createDataFrame([("p", posting), ("q", None)],
                                     "posting_id string, title_embedding array<double>")
    queries = spark.createDataFrame([(1, query)], "query_id int, query_vector array<double>")
    with pytest.raises(Exception, match="needs 2 values"):
        vector_search(postings, queries, dim=2, k=1, vector_col="title_embedding",
                      faceted=False).collect()


def test_chains_move_no_keys(spark, monkeypatch):
    """The rounds of the doubling hold neither ids nor hashes, however long the chain; one with rows that
    wait for two others at its end."""
    rows = [(i, f"p{i // 2}", f"h{(i + 1) // 2}") for i in range(1000)]
    rows += [(1000 + i, f"p{900 + i % 40}", f"h{1000 + i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "arrival int, posting_id string, content_hash string")
    wide, cut = [], keys.cut_lineage
    monkeypatch.setattr(keys, "cut_lineage", lambda frame: wide.append("p" in frame.columns) or cut(frame))
    assert sorted(r.arrival for r in keys.insert_rows(df).collect()) == sequential_insert(rows)
    assert wide.count(False) > 8
    wide.clear()
    few = df.filter("arrival < 1000")
    assert sorted(r.arrival for r in keys.insert_rows(few).collect()) == sequential_insert(rows[:1000])
    assert wide.count(True) <= 6
