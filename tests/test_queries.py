"""Every registered query against its SQL, and properties of the plans."""

import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
from crosstie import catalog
from crosstie.geo.measure import length
from tests.conftest import DATA

SPATIAL = sorted(n for n in catalog.QUERIES if n.startswith("geo_") or n in {
    "pipe_base", "pipe_gradesep", "pipe_private", "pipe_rail", "pipe_context", "pipe_density", "pipe_jurisdiction", "pipe_grid"})


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in os.listdir(f"{DATA}/sf0.01"):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/sf0.01/{f}'")
    yield con
    con.close()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, engine, name):
    df = entries.queries()[name](spark, f"{DATA}/sf0.01")
    cur = engine.execute(entries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    ours = sorted((tuple(cell(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(cell(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert ours == theirs and ours


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", SPATIAL)
def test_no_nested_loops(spark, name):
    df = entries.queries()[name](spark, f"{DATA}/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"NestedLoop|CartesianProduct|BatchEvalPython|ArrowEvalPython", plan)


def test_scans_are_pruned(spark):
    df = entries.queries()["geo_within_line"](spark, f"{DATA}/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))
    assert "struct<p_partkey:bigint>" in schemas and "struct<c_custkey:bigint>" in schemas


def test_entry(spark):
    assert entries.entry(spark).count() > 0


def test_category_counts_sum_to_input(spark, tables):
    counts = entries.queries()["agg_count"](spark, f"{DATA}/sf0.01")
    assert sum(r.n for r in counts.collect()) == tables.crossings.count()


def test_clipped_length_is_no_longer_than_the_line(spark, tables):
    whole = {r.line_id: r.l for r in tables.segments.groupBy("line_id").agg(F.expr(f"sum({length()})").alias("l")).collect()}
    clipped = entries.queries()["geo_clip"](spark, f"{DATA}/sf0.01").groupBy("line_id").agg(F.sum("length").alias("l"))
    for r in clipped.collect():
        assert r.l <= whole[r.line_id] + 0.01
