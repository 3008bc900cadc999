"""Postings -> project catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.mining import mine_triples
from ..operators.recommend import catalog_rows, generate_projects, upsert_catalog


def build_catalog(postings: DataFrame, catalog: DataFrame | None = None, *,
                  generator: Callable[[list[str]], str] | None = None, min_support: int = 25,
                  min_lift: float = 1.0, top_n: int = 200, max_skills: int = 30) -> DataFrame:
    """Mine triples, generate a project for each, and put them into the catalog."""
    triples = mine_triples(postings, min_support=min_support, min_lift=min_lift, top_n=top_n,
                           max_skills=max_skills)
    rows = catalog_rows(generate_projects(triples, generator))
    return rows if catalog is None else upsert_catalog(catalog, rows)
