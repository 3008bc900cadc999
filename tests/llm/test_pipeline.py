"""The stages of the pipeline against plain versions: nulls, repeated ids, clashing columns, no rows."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from skilltide.llm import rows as rw

CLASHES = ("lang_pred string, score string, _copies int, _sha string, _place string, _row int, place int, "
           "copies int, group int, name string, _metadata string, id string")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES
EXTRA = ("x", "y", 9, "z", "p", 1, 2, 3, 4, "n", "m", "i")


def table(spark, texts, folder=None, sources=("s1", "s2", None)):
    """(doc_id, text) rows with columns whose names the stages might use."""
    made = [(i, t, "en", sources[n % len(sources)], len(t or ""), *EXTRA) for n, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    if folder is None:
        return df
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def texts():
    long = " ".join(f"w{i % 700}x{i % 31}" for i in range(30_000))
    base = [f"word{i} " * 3 + " ".join(f"t{i}u{j}" for j in range(40)) for i in range(12)]
    near = [base[3].replace("t3u7", "other"), base[5].replace("t5u39", "end")]
    out = list(enumerate(base)) + [(50, base[0].replace(" ", " \n")), (51, base[0])]
    out += [(60, near[0]), (61, near[1]), (None, base[7]), (None, "a null id and five words more"), (2, base[2]),
            (2, base[9] + " same id as another row"), (70, None), (71, ""), (72, " \n"), (73, "12 34 !!"),
            (74, long), (75, long + " tail"), (76, None)]
    return out


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def kept_rows(df):
    assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    rows = df.collect()
    assert all(tuple(r)[5:] == EXTRA for r in rows)
    return Counter((r["doc_id"], r["text"]) for r in rows)


def smallest(groups):
    order = lambda r: (r[0] is None, r[0] or 0)
    return Counter(min(g, key=order) for g in groups)


def linked(rows, width=5, percent=80):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for _, t in rows]
    sets = [{tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
            for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = defaultdict(list)
    for g, r in zip(group, rows, strict=True):
        out[g].append(r)
    return out.values()


@pytest.mark.parametrize("stored", [True, False])
def test_stages_that_drop_rows(spark, tmp_path, stored):
    rows = texts()
    df = table(spark, rows, str(tmp_path / "docs") if stored else None)
    letters = Counter(r for r in rows if re.search(r"[^\W\d_]", r[1] or ""))
    assert kept_rows(cp.known_language(spark, df, "")) == letters
    by = defaultdict(list)
    for r in rows:
        by[plain(r[1])].append(r)
    got = kept_rows(cp.without_copies(spark, df, ""))
    assert Counter((i, plain(t)) for i, t in got.elements()) == Counter(
        (i, plain(t)) for i, t in smallest(by.values()).elements())
    got = kept_rows(cp.without_near_copies(spark, df, ""))
    want = smallest(linked(rows))
    assert Counter(i for i, _ in got.elements()) == Counter(i for i, _ in want.elements())


def test_mix_repeats_rows(spark, tmp_path):
    rows = texts()
    df = table(spark, rows, str(tmp_path / "docs"), sources=("s1",))
    got = kept_rows(cp.mixed(spark, df, ""))
    again = kept_rows(cp.mixed(spark, table(spark, rows[::-1], str(tmp_path / "more"), sources=("s1",)), ""))
    assert got == again and set(got) <= set(rows)
    given = Counter(rows)
    assert all(got[r] == given[r] for r in given if not (r[1] or "").split())
    size = lambda c: sum(len((t or "").split()) * n for (_, t), n in c.items())
    longest = max(len((t or "").split()) for _, t in rows)
    assert abs(size(got) - 1.5 * size(given)) <= longest + 16


def test_empty_table(spark):
    df = table(spark, [])
    for _, stage in cp.STAGES[:-1]:
        assert kept_rows(stage(spark, df, "")) == Counter()
    assert cp.encoded(spark, df, "").count() == 0


@pytest.mark.parametrize("most", [rw.MAX_PIECES, 1])
def test_repeated(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(rw, "MAX_PIECES", most)
    monkeypatch.setattr(rw, "PACK", 16)
    spark.range(500).withColumn("_path", F.lit("c")).repartition(4).write.parquet(str(tmp_path / "t"))
    placed, key = rw.with_places(spark.read.parquet(str(tmp_path / "t")))
    copies = placed.filter("id % 7 <> 3").select(F.col(key).alias("place"), (F.col("id") % 5).alias("copies"))
    got = Counter(r["id"] for r in rw.repeated(placed, key, copies).collect())
    assert got == Counter({i: i % 5 for i in range(500) if i % 7 != 3 and i % 5})


def test_no_text_is_shuffled(spark, tmp_path):
    df = table(spark, texts(), str(tmp_path / "docs"))
    for stage in (cp.known_language, cp.without_copies, cp.without_near_copies, cp.mixed):
        plan = stage(spark, df, "")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" in plan and "Exchange hashpartitioning" not in plan


def test_whole_run(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    assert got.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
