"""Every registered query of the core against its SQL on the smallest tables, and plans of some."""

import math
import os

import duckdb
import pytest

from sparkloom import catalog
from sparkloom import functions as fn
from sparkloom.engine import Engine
from sparkloom.operators import criteria as cr
from sparkloom.operators.expr import param
from sparkloom.plans.select import SelectQuery, columns_equal, from_, inner_join
from sparkloom.sources.writes import deleted, updated

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cur = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cur.fetchall(), columns)


def test_seconds_over_all_events(spark):
    assert catalog.queries()["seconds_since_first"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_bounded_queries_have_whole_ones(spark):
    rows = catalog.queries()["nulls_first_over_all"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert max(r["place"] for r in rows if r["q"] is None) < min(r["place"] for r in rows if r["q"] is not None)
    assert "o_orderkey <=" not in plan(catalog.queries()["filter_compare_all"](spark, SF))


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_windows_over_all_rows_in_ranges(spark, duck, monkeypatch, ranges):
    """Whatever the ranges that order values are cut into; within a range, not over all values, is one task's window."""
    monkeypatch.setattr("sparkloom.plans.compile.RANGES", ranges)
    for name in ("window_over_all", "window_over_all_nulls", "nulls_first_over_all"):
        test_query_equals_sql(spark, duck, name)
    assert "partitionBy" not in plan(catalog.window_over_all(spark, SF)) and plan(catalog.window_over_all(spark, SF)).count("windowspecdefinition(_range") >= 2


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    t = catalog.Tables(spark, SF)
    o, c = t["orders"].as_("o"), t["customer"].as_("c")
    some = t.engine.explain(SelectQuery(select=[o.of("o_orderkey").as_("k")], source=o, where=cr.above(o.of("o_totalprice"), 1.0)))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1.0)]" in some
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in some
    assert "TakeOrderedAndProject" in plan(catalog.top_k(spark, SF))
    assert "LeftSemi" in plan(catalog.exists_correlated(spark, SF))
    assert "LeftAnti" in plan(catalog.not_exists(spark, SF))
    assert "CartesianProduct" not in plan(catalog.inner_join_query(spark, SF))
    assert "TakeOrderedAndProject" in plan(catalog.keyset_after(spark, SF))
    sub = SelectQuery(select=[o.of("o_custkey").as_("k")], source=o)
    assert "LeftSemi" in t.engine.explain(SelectQuery(select=[c.of("c_custkey").as_("k")], source=c, where=cr.in_query(c.of("c_custkey"), sub)))
    assert columns_equal(o, "o_custkey", c, "c_custkey").reasons() == []


def test_rows_outside_a_query_are_not_broadcast(spark):
    """NOT IN is shuffled where its query is too large for a broadcast; one left to Spark is broadcast whatever its size."""
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        physical = catalog.not_in_query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in physical and "LeftAnti" in physical and "Broadcast" not in physical


A = [(1, 1), (2, 2), (3, None), (None, 4)]
B = [(2, 1), (5, 3), (None, None)]


@pytest.mark.parametrize("rows", ["TRUE", "k IS NOT NULL", "FALSE"], ids=["with a null", "without nulls", "empty"])
def test_rows_outside_a_query(spark, rows):
    """NOT IN wherever it stands, nulls among the query's rows, nulls as the term, no rows."""
    e = Engine(spark, {"a": spark.createDataFrame(A, "k int, v int"), "b": spark.createDataFrame(B, "k bigint, v int")})
    a, b, same = from_("a"), from_("b"), from_("a")
    some = lambda t, c: {"TRUE": cr.every_row(), "FALSE": cr.no_row()}.get(rows, cr.is_not_null(t.of(c)))
    sub = SelectQuery(select=[b.of("k").as_("k")], source=b, where=some(b, "k"))
    out = lambda term, query=sub: cr.not_(cr.in_query(term, query))
    own = SelectQuery(select=[same.of("v").as_("k")], source=same, where=some(same, "v"))
    near = SelectQuery(select=[b.of("k").as_("k")], source=b, where=cr.and_(some(b, "k"), columns_equal(a, "v", b, "v")))
    first = SelectQuery(select=[b.of("k").as_("k")], source=b, where=some(b, "k"), order_by=[b.of("k").desc()], limit=1)
    s = f"(SELECT k FROM b WHERE {rows})"
    both = cr.and_(columns_equal(a, "v", b, "v"), out(a.of("k"), own))
    v, select = [a.of("v").as_("v")], lambda where: SelectQuery(select=[a.of("v").as_("v")], source=a, where=where)
    sub_own = f"(SELECT v FROM a WHERE {rows.replace('k', 'v')})"
    for query, sql in (
        (select(out(a.of("k"))), f"SELECT v FROM a WHERE k NOT IN {s}"),
        (select(cr.not_(cr.bracket(out(a.of("k"))))), f"SELECT v FROM a WHERE NOT (k NOT IN {s})"),
        (select(cr.or_(out(a.of("k")), cr.equal(a.of("v"), 2))), f"SELECT v FROM a WHERE k NOT IN {s} OR v = 2"),
        (select(cr.is_null(out(a.of("k")))), f"SELECT v FROM a WHERE (k NOT IN {s}) IS NULL"),
        (SelectQuery(select=[*v, out(a.of("k")).as_("x")], source=a), f"SELECT v, k NOT IN {s} AS x FROM a"),
        (select(out(fn.plus(a.of("k"), a.of("v")))), f"SELECT v FROM a WHERE k + v NOT IN {s}"),
        (select(out(param(5))), f"SELECT v FROM a WHERE 5 NOT IN {s}"),
        (SelectQuery(select=v, source=a, group_by=[a.of("v")], having=out(fn.max_(a.of("k")))), f"SELECT v FROM a GROUP BY v HAVING max(k) NOT IN {s}"),
        (select(out(a.of("k"), own)), f"SELECT v FROM a WHERE k NOT IN {sub_own}"),
        (SelectQuery(select=v, source=a, joins=[inner_join(b, both)]), f"SELECT a.v FROM a JOIN b ON a.v = b.v AND a.k NOT IN {sub_own}"),
        (select(out(a.of("k"), near)), f"SELECT v FROM a WHERE k NOT IN (SELECT k FROM b WHERE ({rows}) AND b.v = a.v)"),
        (select(out(a.of("k"), first)), f"SELECT v FROM a WHERE k NOT IN (SELECT k FROM b WHERE {rows} ORDER BY k DESC NULLS LAST LIMIT 1)"),
    ):
        assert sorted(map(repr, map(tuple, e.compile(query).collect()))) == sorted(map(repr, of_tables(sql))), sql
    left = f"SELECT k, v FROM a WHERE NOT coalesce(k NOT IN {s}, FALSE)"
    assert sorted(map(repr, map(tuple, deleted(e, a, out(a.of("k"))).collect()))) == sorted(map(repr, of_tables(left)))
    changed = f"SELECT k, CASE WHEN k NOT IN {s} THEN 9 ELSE v END FROM a"
    assert sorted(map(repr, map(tuple, updated(e, a, {"v": 9}, out(a.of("k"))).collect()))) == sorted(map(repr, of_tables(changed)))


def of_tables(sql):
    c = duckdb.connect()
    for name, rows in (("a", A), ("b", B)):
        c.execute(f"CREATE TABLE {name} (k BIGINT, v INT)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return c.execute(sql).fetchall()


def test_entry(spark):
    assert catalog.entry(spark, SF).count() == 150
