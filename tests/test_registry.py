"""Every registered query of the corpus operators, held against its SQL on the smallest tables."""

import duckdb
import pytest

from lexigrid.plans.registry import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "events")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    relation = db.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    assert plain(df.select(*columns).collect()) == plain(relation.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert not QUERIES[name](spark, SMALL).isEmpty()


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["paper_id", "score", "year", "total_matches"]


def test_plans_prune_and_push_down(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    p = plan(QUERIES["pruned_scan"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,1000)]" in p and "struct<lang:string,source:string,n_chars:bigint>" in p
    assert "TakeOrderedAndProject" in plan(QUERIES["top_categories"](spark, SMALL))
    assert "WindowGroupLimit" in plan(QUERIES["ctfidf"](spark, SMALL))
    for name in ("share_by_year", "orphan_remap", "search_ranked", "ctfidf"):
        assert "Python" not in plan(QUERIES[name](spark, SMALL))
