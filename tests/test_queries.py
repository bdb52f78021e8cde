import math
import os
from collections import Counter

import duckdb
import pytest

from pixelspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return bool(value) if isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, tables, name):
    found = registry.queries()[name](spark, SF)
    want = tables.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    rows = lambda x: Counter(tuple(map(plain, r)) for r in x)
    assert rows(found.select(*want.columns).collect()) == rows(want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_projections_reach_the_scan(spark):
    from pixelspark.plans import inputs

    plan = inputs.linear_rgb(spark, SF).where("k < 100").select("r")._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" in plan and "l_extendedprice" not in plan.split("ReadSchema")[1]
    assert "PushedFilters: [IsNotNull(l_orderkey), LessThan(l_orderkey,100)]" in plan


@pytest.mark.parametrize("name,shuffles", [("color_transfer_curves", 0), ("color_ycbcr", 0), ("tone_curves", 0), ("integer_math", 0), ("byte_codecs", 1), ("image_files", 1), ("subtract_green", 0), ("tiff_predictor", 1), ("png_filter_choice", 1), ("alpha_filter_choice", 1), ("predictor_modes", 1), ("chroma_420", 1), ("block_stats", 1), ("adler32", 1), ("byte_histogram", 1), ("loop_filter_masks", 1), ("block_directions", 1)])
def test_number_of_shuffles(spark, name, shuffles):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == shuffles and "CartesianProduct" not in plan
