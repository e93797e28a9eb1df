import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = (
    "route_totals", "plan_tokens", "plan_resolve", "feed_pilots", "traffic_board", "presence_changes", "tile_coverage",
    "eviction_plan", "viewport_tiles", "sheet_fits", "nearest_plan_point", "arrow_extract", "anchor_overlap", "stale_sources",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_names_line_up():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
    assert own <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "plan_id" and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr(tuple(r[cols.index(c)] for c in sorted(cols))) for r in cur.fetchall())
    got = sorted(repr(tuple(r[c] for c in sorted(cols))) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", ["nearest_waypoint", "nearest_plan_point", "arrow_candidates", "arrow_labels"])
def test_spatial_joins_are_equi_joins(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
