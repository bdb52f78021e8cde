import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as p  # noqa: E402
from pixelspark.llm import decontaminate, registry  # noqa: E402
from pixelspark.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(10_000, None, "en", "src0", 0), (10_001, "1 2 3", None, None, 5)], docs.schema)
    docs = docs.unionAll(odd)
    (_, lang), (_, near), (_, leaks), (_, mix), (_, tokens) = p.STAGES
    kept = lang(spark, docs, SF).cache()
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {10_000, 10_001}

    from test_similar import kept as apart_of

    apart = near(spark, kept, SF).cache()
    assert sorted(r.doc_id for r in apart.collect()) == apart_of([(r.doc_id, r.text) for r in kept.collect()])

    items = [decontaminate.normal(r.text.encode()) for r in table(spark, SF, "benchmark").collect()]
    clean = leaks(spark, apart, SF).cache()
    assert {r.doc_id for r in apart.collect()} - {r.doc_id for r in clean.collect()} >= {r.doc_id for r in apart.collect() if any(x in decontaminate.normal(r.text.encode()) for x in items)}
    assert clean.count() > 0.8 * apart.count()

    mixed = mix(spark, clean, SF).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    out = tokens(spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())


def test_whole_run_and_order(spark):
    found = p.run(spark, SF).collect()
    assert found and len(p.STAGES) == 5
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in found)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    found = registry.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(want.columns)
    assert Counter(map(tuple, found.select(*want.columns).collect())) == Counter(want.fetchall())
