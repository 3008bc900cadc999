"""Every registered query against its SQL on the smallest tables, and checks of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from workload.queries import QUERIES as WORKLOAD
from tools.check import TABLES, rows_of

# The corpus operators have tests of their own, and not all can be said in SQL.
QUERIES = {name: fn for name, fn in entry.queries().items() if name in WORKLOAD}


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, sql, name):
    df = QUERIES[name](spark, sf_dir)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    mine = rows_of(df.columns, df.collect())
    result = sql.execute(entry.oracle_sql()[name])
    assert mine == rows_of([d[0] for d in result.description], result.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(WORKLOAD) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["top_items", "triple_support", "trigram_topk", "fuzzy_lookup",
                                  "taxonomy_tree", "dedup_first_wins", "gazetteer_items",
                                  "normalize_items", "subset_join", "set_cover"])
def test_jvm_only_plans(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = plan_of(QUERIES["top_items"](spark, sf_dir))
    assert "struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert "struct<p_partkey:bigint,p_brand:string>" in plan


def test_result_does_not_depend_on_the_layout(spark, sf_dir):
    from skilltide.operators import retrieval
    from workload import views

    rows, asked = views.stored_postings(spark, sf_dir), views.asked(spark, sf_dir)
    small = retrieval.HybridSettings(semantic_pool=30, lexical_pool=20)

    def run(df):
        found = retrieval.hybrid_scores(df, asked, dim=views.VECTOR_DIM, settings=small)
        return sorted(tuple(r) for r in found.collect())

    assert run(rows) == run(rows.repartition(7)) == run(rows.orderBy("company").coalesce(2))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
