"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quern import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(_plain(r[c]) for c in names)) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    out = con.execute(sql)
    head = [d[0] for d in out.description]
    assert sorted(head) == names
    want = sorted(repr(tuple(_plain(r[head.index(c)]) for c in names)) for r in out.fetchall())
    assert got == want


def test_law_forms_without_words(spark, tmp_path):
    spark.createDataFrame([(i, x) for i, x in enumerate(("", "a b", "", "eins zwei drei vier", "", "- -"))], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.kind, r.core, r.year) for r in catalog.queries()["law_forms"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(catalog.oracle_sql()["law_forms"])
    head = [d[0] for d in cur.description]
    assert got == sorted(tuple(r[head.index(c)] for c in ("doc_id", "kind", "core", "year")) for r in cur.fetchall())


def test_law_match_sends_nothing_to_all_workers(spark):
    plan = catalog.queries()["law_match"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stored_tables_are_written_by_several_tasks_in_order(spark, tmp_path):
    from quern.queries.sources import stored
    from quern.sources import readers

    rows = spark.range(1000).select(F.col("id").alias("_key"), (F.col("id") * 2).alias("x"))
    path = stored(f"file://{tmp_path}", "t", "_key", rows.filter("_key % 2 = 0").orderBy(F.desc("_key")), rows.filter("_key % 2 = 1"))
    back = readers.numbered(readers.read(spark, path))
    assert back.inputFiles() and len(back.inputFiles()) > 2
    assert [r.x for r in back.orderBy(readers.NUMBER).collect()] == [2 * i for i in (*range(0, 1000, 2), *range(1, 1000, 2))]
