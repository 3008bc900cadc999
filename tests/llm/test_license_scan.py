"""License scans: base places against a plain word loop, diagonals against a plain dictionary version."""

import random
import re
from collections import defaultdict

import pytest

from skilltide.llm import license_scan as ls
from skilltide.llm import queries

SCHEMA = "doc_id long, text string, label string, row long, template string, hash long, base boolean"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({ord(u): low for u, low in zip(ls.UPPER, ls.LOWER)}))


def edited(rng, text, n):
    out = text.split()
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at:at + rng.randrange(2)] = ["Holder"] * rng.randrange(3)
    return " ".join(out)


def corpus(seed=2):
    rng = random.Random(seed)
    filler = "the of and License general public GNU apache MIT by CC to this software work copy".split()
    texts = [None, "", " \n", "CC BY", "cc-by-cc_by", "Apache  LICENSE, mit\x00license", "ccby cc by4",
             "GNU General Public Licenseé", "gnu general public license gnu general public license",
             "KELVIN K mit licenſe", "日本 mit license 語", "mit license " * 4000, "x" * 50_000 + " mit license"]
    for label, notice in ls.NOTICES:
        for n in (0, 1, 3, 6, 40):
            texts.append(" ".join(rng.choices(filler, k=30)) + " " + edited(rng, notice, n) + " end " + " ".join(
                rng.choices(filler, k=30)))
        texts.append(f"{notice} and {edited(rng, notice, 2)}")
    texts += [" ".join(rng.choices(filler, k=rng.randrange(80))) for _ in range(150)]
    rows = [(i, t, "clash", i, "clash", 7, True) for i, t in enumerate(texts)]
    return [*rows, (None, "mit license", "", 0, "", 0, False), rows[3], rows[3]]


def spans_of(text, gram=ls.GRAM, min_share=ls.MIN_SHARE):
    own, found = words_of(text), []
    for base, rows in ((True, ls.PHRASES), (False, ls.NOTICES)):
        for label, notice in rows:
            sample = words_of(notice)
            k, slack = min(gram, len(sample)), int(len(sample) * ls.SLACK) if len(sample) > gram else 0
            places = defaultdict(list)
            for t in range(len(sample) - k + 1):
                places[tuple(sample[t:t + k])].append(t)
            diagonals = defaultdict(set)
            for d in range(len(own) - k + 1):
                for t in places.get(tuple(own[d:d + k]), ()):
                    diagonals[d - t] |= set(range(t, t + k))
            groups, last = [], None
            for g in sorted(diagonals):
                if last is None or g - last > slack:
                    groups.append([])
                groups[-1].append(g)
                last = g
            for group in groups:
                covered = set().union(*(diagonals[g] for g in group))
                at = [g + t for g in group for t in diagonals[g]]
                if len(covered) >= len(sample) * min_share:
                    found.append((min(at), max(at) + 1, label, base, len(covered), len(sample)))
    return sorted(found)


def base_of(text):
    own, places = words_of(text), []
    for label, phrase in ls.PHRASES:
        want = phrase.split()
        places += [(i, label) for i in range(len(own)) if own[i:i + len(want)] == want]
    return own, places


@pytest.mark.parametrize("few", [ls.MAX_POSITIONS, 10])
def test_spans_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(ls, "MAX_POSITIONS", few)  # both joins
    rows = corpus()
    got = defaultdict(list)
    for r in ls.license_spans(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        got[r["doc_id"]].append((r["n_words"], [tuple(s)[:6] for s in r["spans"]]))
    assert sum(map(len, got.values())) == len(rows)
    for i, text, *_ in rows:
        want = [(a, b, label, base, c, n) for a, b, label, base, c, n in spans_of(text)]
        for n_words, spans in got[i]:
            assert n_words == len(words_of(text)) and sorted(spans) == want


def test_query_columns(spark):
    rows = corpus(3)
    found = queries.license_columns(ls.license_spans(spark.createDataFrame(rows, SCHEMA))).collect()
    by = {r["doc_id"]: r for r in found}
    for i, text, *_ in rows:
        own, places = base_of(text)
        r, spans = by[i], spans_of(text)
        assert (r["n_words"], r["n_base"]) == (len(own), len(places))
        assert r["first_word"] == min((p for p, _ in places), default=None)
        assert r["last_word"] == max((p for p, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert r["labels"] == ",".join(sorted({s[2] for s in spans}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert r["score"] == pytest.approx(max((s[4] / s[5] for s in spans), default=0.0))


def test_notices_are_found(spark):
    rng = random.Random(8)
    rows = [(i, "Intro words here. " + edited(rng, text, 2) + " Tail.", "", 0, "", 0, False)
            for i, (_, text) in enumerate(ls.NOTICES)]
    got = queries.license_columns(ls.license_spans(spark.createDataFrame(rows, SCHEMA)))
    for r in got.collect():
        assert ls.NOTICES[r["doc_id"]][0] in r["labels"].split(",") and r["score"] > 0.6


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ls.license_spans(none).count() == 0
    docs = spark.createDataFrame(corpus()[:8], SCHEMA)
    no = spark.createDataFrame([(None, "x y", True), ("a", None, False), ("b", " ", None)],
                               "label string, text string, base boolean")
    assert all(r["spans"] == [] for r in ls.license_spans(docs, no).collect())
