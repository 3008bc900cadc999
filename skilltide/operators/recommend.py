"""Project catalog rows and recommendations from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import CATALOG_NAMESPACE, uuid5
from ..functions.text import _col, strip
from .keys import upsert
from .scale import top_k_per_group

# Request and answer sizes, levels of a project.
TOP_SKILLS_USED = 5
MIN_PROJECTS = 3
MAX_PROJECTS = 4
LEVELS = ("BEGINNER", "INTERMEDIATE", "ADVANCED")
DEFAULT_LEVEL = "INTERMEDIATE"


def skills_key(skills: Column | str) -> Column:
    return F.array_join(F.array_sort(F.transform(_col(skills), lambda s: F.lower(s))), "|")


def template_project(skills: Column | str) -> Column:
    """Default generator: a project text made from the triple alone, as JSON."""
    s = _col(skills)
    names = F.array_join(s, ", ")
    return F.to_json(F.struct(
        F.concat_ws(" ", F.get(s, 0), F.lit("and"), F.get(s, 1), F.lit("with"), F.get(s, 2))
        .alias("title"),
        F.lit(DEFAULT_LEVEL).alias("level"),
        F.concat(F.lit("Build one small application in which "), names,
                 F.lit(" each have a real job.")).alias("blurb")))


def generate_projects(triples: DataFrame, generator: Callable[[list[str]], str] | None = None
                      ) -> DataFrame:
    """Add ``reply`` (JSON text) to triples (s1, s2, s3, ...).

    ``generator`` runs per triple in Python workers; where it fails the reply is NULL and the
    triple is skipped later, while the batch goes on.
    """
    rows = triples.withColumn("skills", F.array("s1", "s2", "s3"))
    if generator is None:
        return rows.withColumn("reply", template_project("skills"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def attempt(skills: list[str]) -> str | None:
            try:
                return generator(list(skills))
            except Exception:
                return None

        for batch in batches:
            yield batch.assign(reply=[attempt(s) for s in batch["skills"]])

    schema = rows.limit(0).withColumn("reply", F.lit(None).cast("string")).schema
    return rows.mapInPandas(run, schema)


def validated_project(reply: Column | str) -> Column:
    """struct<title, level, blurb> of a generator's reply; NULL when a text is missing."""
    reply = _col(reply)
    doc = F.when(F.try_parse_json(reply).isNotNull(), reply)

    def field(name: str) -> Column:
        return F.coalesce(strip(F.get_json_object(doc, f"$.{name}")), F.lit(""))

    level = F.upper(field("level"))
    title, blurb = field("title"), field("blurb")
    level = F.when(level.isin(*LEVELS), level).otherwise(DEFAULT_LEVEL)
    return F.when((title != "") & (blurb != ""), F.struct(
        title.alias("title"), level.alias("level"), blurb.alias("blurb")))


def catalog_rows(generated: DataFrame, now: Column | None = None) -> DataFrame:
    """Catalog rows of generated triples; replies that do not validate are left out."""
    key = skills_key("skills")
    checked = generated.withColumn("project", validated_project("reply"))
    return checked.filter(F.col("project").isNotNull() & (F.size("skills") == 3)).select(
        uuid5(CATALOG_NAMESPACE, key).alias("project_id"),
        F.col("project.title").alias("title"), F.col("project.level").alias("level"),
        F.col("project.blurb").alias("blurb"), "skills",
        F.col("support_count").cast("int").alias("support_count"),
        F.col("lift").cast("float").alias("lift"),
        F.col("support_count").cast("float").alias("score"),
        key.alias("skills_key"),
        (F.current_timestamp() if now is None else now).alias("generated_at"))


def upsert_catalog(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same project; the others stay."""
    return upsert(catalog, new, ["project_id"])


def parse_skill_list(text: Column | str) -> Column:
    """'a, b,,c' -> [a, b, c]; NULL for blank text (a request without skills is an error)."""
    text = _col(text)
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda s: s != "")
    return F.when(strip(text) != "", parts)


def _subsets(top: Column) -> Column:
    """All sorted distinct subsets of at most five skills, the empty one included (32 at most)."""
    def with_and_without(sets: Column, s: Column) -> Column:
        return F.concat(sets, F.transform(sets, lambda chosen: F.concat(chosen, F.array(s))))

    items = F.array_sort(F.array_distinct(F.filter(top, lambda s: s.isNotNull())))
    return F.aggregate(items, F.array(F.array().cast("array<string>")), with_and_without)


def subset_join(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, top_skills, project columns): all projects whose skills are all among the
    first five requested ones.

    Containment becomes an equi-join: a request gives every subset it can contain as a key.
    Skills that are NULL are contained in nothing.
    """
    top = F.slice("skills", 1, TOP_SKILLS_USED)
    asked = requests.select("query_id", top.alias("top_skills")).filter(
        F.size("top_skills") >= 3)
    keys = asked.select("query_id", "top_skills", F.explode_outer(_subsets(F.col("top_skills")))
                        .alias("skill_set"))
    keyed = catalog.withColumn("skill_set", _skill_set()).filter(
        F.size("skill_set") <= TOP_SKILLS_USED)
    return keys.join(keyed, "skill_set").drop("skill_set")


def _skill_set() -> Column:
    return F.array_sort(F.array_distinct("skills"))


def best_of_each_set(catalog: DataFrame) -> DataFrame:
    """The four best projects of every skill set: no greedy answer holds more than four, so a
    request meets at most 128 rows, however often a skill set occurs."""
    keyed = catalog.withColumn("_set", _skill_set())
    return top_k_per_group(keyed, ["_set"], [F.desc("score"), F.asc("project_id")],
                           MAX_PROJECTS).drop("_set")


def _greedy(candidates: Column, target: Column) -> Column:
    """Positions of the greedy picks over candidates in score order.

    Each of at most four steps takes the first candidate that covers most still uncovered
    skills. From three picks on it stops at no gain or at full cover.
    """
    start = F.struct(F.array().cast("array<string>").alias("covered"),
                     F.array().cast("array<int>").alias("picked"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        gains = F.transform(candidates, lambda c, i: F.when(
            F.array_contains(state["picked"], i), -1).otherwise(
            F.size(F.array_except(c["skills"], state["covered"]))))
        best = F.array_max(gains)
        enough = F.size(state["picked"]) >= MIN_PROJECTS
        stop = (state["done"] | F.coalesce(best < 0, F.lit(True)) | ((best == 0) & enough))
        place = (F.array_position(gains, best) - 1).cast("int")
        covered = F.array_union(state["covered"], F.get(candidates, place)["skills"])
        picked = F.concat(state["picked"], F.array(place))
        full = (F.size(covered) >= target) & (F.size(picked) >= MIN_PROJECTS)
        return F.when(stop, F.struct(
            state["covered"].alias("covered"), state["picked"].alias("picked"),
            F.lit(True).alias("done"))).otherwise(F.struct(
                covered.alias("covered"), picked.alias("picked"), full.alias("done")))

    rounds = F.array(*[F.lit(i) for i in range(MAX_PROJECTS)])
    return F.aggregate(rounds, start, step, lambda s: s["picked"])


def recommend(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, top_skills, projects): three or four projects that together cover most of the
    requested skills; none for fewer than three skills. ``requests`` is (query_id, skills)."""
    found = subset_join(requests, best_of_each_set(catalog))
    grouped = found.groupBy("query_id", "top_skills").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score").cast("double")).alias("order"), "project_id", "title", "level", "blurb",
        F.col("skills").alias("skills")))).alias("candidates"))
    picked = grouped.withColumn("picks", _greedy(F.col("candidates"), F.size("top_skills")))
    projects = F.transform("picks", lambda i: F.get(F.col("candidates"), i))
    answers = picked.select("query_id", F.transform(projects, lambda p: F.struct(
        p["project_id"].alias("project_id"), p["title"].alias("title"),
        p["level"].alias("level"), p["blurb"].alias("blurb"),
        p["skills"].alias("skills"))).alias("projects"))
    asked = requests.select("query_id", F.slice("skills", 1, TOP_SKILLS_USED).alias("top_skills"))
    return asked.join(answers, "query_id", "left").withColumn(
        "projects", F.coalesce("projects", F.array().cast(answers.schema["projects"].dataType)))


def recommended_projects(answers: DataFrame) -> DataFrame:
    """One row per recommended project: (query_id, pick, project_id, title, skills)."""
    return answers.select("query_id", F.posexplode("projects").alias("pick", "p")).select(
        "query_id", (F.col("pick") + 1).alias("pick"), "p.project_id", "p.title", "p.level",
        "p.skills")
