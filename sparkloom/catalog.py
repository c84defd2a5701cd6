"""Registered queries of the library's own operators, each with equivalent SQL over the same tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as SF

from sparkloom import functions as fn
from sparkloom import stored_catalog
from sparkloom.engine import Engine
from sparkloom.kinds import Kind
from sparkloom.operators import criteria as cr
from sparkloom.operators.expr import Selection, Window, apply, column, param, subquery
from sparkloom.operators.listing import PageQuery, listing
from sparkloom.operators.operations import declare, function
from sparkloom.operators.search import Match, declare_search, matches
from sparkloom.plans.select import SelectQuery, columns_equal, from_, inner_join, left_join, with_
from sparkloom.plans.statement import bind, compose, table
from sparkloom.sources.evolve import Addition, History, Recomputation, Removal, Rename, Retype, migrate_rows
from sparkloom.sources.mapping import assembled, flattened, taken_apart, unflattened
from sparkloom.sources.parquet import ParquetFolder
from sparkloom.sources.writes import deleted, inserted, updated, upserted

#: Rounding and ranking are not among the library's operations; they are declared here as any caller would.
ROUND = declare("round", function("round", 2))
ROW_NUMBER = declare("row number", function("row_number", 0))
INITCAP = declare("initial capitals", function("initcap", 1))

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def registered(sql: str):
    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def rounded(e, n=2):
    return apply(ROUND, e, n, kind=Kind.NUMBER)


class Tables:
    """Sources and engine of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.folder = ParquetFolder(spark, sf_dir)
        self.engine = Engine(spark, self.folder)

    def __getitem__(self, name):
        return self.folder.source(name)

    def run(self, **parts) -> DataFrame:
        return self.engine.compile(SelectQuery(**parts))


def named(source, *names: str) -> list[Selection]:
    return [Selection(source.of(n), n) for n in names]


# filter, projection, top-k


@registered("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice >= 150000 AND o_totalprice < 200000 AND o_orderstatus <> 'F' AND o_totalprice <= 190000 AND o_custkey > 10")
def filter_compare_all(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    where = cr.and_(cr.at_least(o.of("o_totalprice"), 150000.0), cr.below(o.of("o_totalprice"), 200000.0), cr.not_equal(o.of("o_orderstatus"), "F"), cr.at_most(o.of("o_totalprice"), 190000.0), cr.above(o.of("o_custkey"), 10))
    return t.run(select=named(o, "o_orderkey", "o_totalprice", "o_orderstatus"), source=o, where=where)


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    return t.run(select=named(o, "o_orderkey", "o_totalprice"), source=o, order_by=[o.of("o_totalprice").desc(), o.of("o_orderkey").asc()], limit=100)


@registered("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 200")
def limit_offset(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    return t.run(select=named(o, "o_orderkey"), source=o, order_by=[o.of("o_orderdate").asc(), o.of("o_orderkey").asc()], limit=50, offset=200)


@registered("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND event_type = 'click'")
def moment_compare(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = t["events"]
    return t.run(select=named(e, "event_id", "event_type"), source=e, where=cr.and_(cr.at_least(e.of("ts"), dt.datetime(2024, 1, 2)), cr.equal(e.of("event_type"), "click")))


@registered("SELECT r_regionkey, r_name FROM region WHERE r_name <> 'ASIA'")
def unchecked_columns(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.run(select=[column("r_regionkey").as_("r_regionkey"), column("r_name").as_("r_name")], source=from_("region"), where=cr.not_equal(column("r_name"), "ASIA"))


# joins


@registered("SELECT o_orderkey, c_name, c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c_mktsegment = 'BUILDING'")
def inner_join_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o, c = t["orders"].as_("o"), t["customer"].as_("c")
    return t.run(select=[*named(o, "o_orderkey"), *named(c, "c_name", "c_mktsegment")], source=o, joins=[inner_join(c, columns_equal(o, "o_custkey", c, "c_custkey"))], where=cr.equal(c.of("c_mktsegment"), "BUILDING"))


@registered("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d, lab = t["documents"].as_("d"), t["labels"].as_("l")
    return t.run(select=[*named(d, "doc_id", "lang"), *named(lab, "quality", "toxic")], source=d, joins=[left_join(lab, columns_equal(d, "doc_id", lab, "doc_id"))])


@registered("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey AND s.s_acctbal > 5000")
def theta_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s, n = t["supplier"].as_("s"), t["nation"].as_("n")
    return t.run(select=[*named(s, "s_suppkey"), *named(n, "n_nationkey")], source=s, joins=[inner_join(n, cr.and_(cr.below(s.of("s_nationkey"), n.of("n_nationkey")), cr.above(s.of("s_acctbal"), 5000.0)))])


@registered("SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def self_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a, b = t["nation"].as_("a"), t["nation"].as_("b")
    return t.run(select=[a.of("n_nationkey").as_("a_key"), b.of("n_nationkey").as_("b_key")], source=a, joins=[inner_join(b, columns_equal(a, "n_regionkey", b, "n_regionkey"))], where=cr.below(a.of("n_nationkey"), b.of("n_nationkey")))


@registered("SELECT n.n_name, r.r_name, c.c_custkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def fk_join(spark, sf_dir):
    from sparkloom.sources.tables import ForeignKey, Table, join_by_key

    t = Tables(spark, sf_dir)
    tables = {
        "customer": Table("customer", (), ("c_custkey",), foreign_keys=(ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),)),
        "nation": Table("nation", (), ("n_nationkey",), foreign_keys=(ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),)),
        "region": Table("region", (), ("r_regionkey",)),
    }
    c, n, r = t["customer"].as_("c"), t["nation"].as_("n"), t["region"].as_("r")
    joins = [join_by_key(tables["customer"], c, tables["nation"], n), join_by_key(tables["region"], r, tables["nation"], n, joined=r)]
    return t.run(select=[*named(n, "n_name"), *named(r, "r_name"), *named(c, "c_custkey")], source=c, joins=joins)


# aggregation


@registered("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def count_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    return t.run(select=[*named(o, "o_orderstatus"), fn.count().as_("n")], source=o, group_by=[o.of("o_orderstatus")])


@registered("SELECT d.lang, count(*) AS n, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
def count_of_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d, lab = t["documents"].as_("d"), t["labels"].as_("l")
    return t.run(select=[*named(d, "lang"), fn.count().as_("n"), fn.count_of(lab.of("quality")).as_("labelled")], source=d, joins=[left_join(lab, columns_equal(d, "doc_id", lab, "doc_id"))], group_by=[d.of("lang")])


@registered("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand")
def sum_whole(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t["part"]
    return t.run(select=[*named(p, "p_brand"), fn.sum_(p.of("p_size")).as_("total")], source=p, group_by=[p.of("p_brand")])


@registered("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus")
def sum_number(spark, sf_dir):
    t = Tables(spark, sf_dir)
    x = t["lineitem"]
    return t.run(select=[*named(x, "l_returnflag", "l_linestatus"), rounded(fn.sum_(x.of("l_extendedprice"))).as_("total")], source=x, group_by=[x.of("l_returnflag"), x.of("l_linestatus")])


@registered("SELECT p_brand, round(avg(p_size), 6) AS mean FROM part GROUP BY p_brand")
def avg_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t["part"]
    return t.run(select=[*named(p, "p_brand"), rounded(fn.avg(p.of("p_size")), 6).as_("mean")], source=p, group_by=[p.of("p_brand")])


@registered("SELECT o_custkey, min(o_totalprice) AS low, max(o_totalprice) AS high, max(o_orderpriority) AS last FROM orders GROUP BY o_custkey")
def min_max(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    return t.run(select=[*named(o, "o_custkey"), fn.min_(o.of("o_totalprice")).as_("low"), fn.max_(o.of("o_totalprice")).as_("high"), fn.max_(o.of("o_orderpriority")).as_("last")], source=o, group_by=[o.of("o_custkey")])


@registered("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_agg_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    n = t["nation"]
    return t.run(select=[*named(n, "n_regionkey"), fn.string_agg(n.of("n_name"), ", ").as_("names")], source=n, group_by=[n.of("n_regionkey")])


@registered("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND max(o_totalprice) > 200000")
def group_having(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    return t.run(select=[*named(o, "o_custkey"), fn.count().as_("n")], source=o, group_by=[o.of("o_custkey")], having=cr.and_(cr.at_least(fn.count(), 12), cr.above(fn.max_(o.of("o_totalprice")), 200000.0)))


@registered("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, sum(o_totalprice) DESC, o_custkey LIMIT 20")
def order_by_aggregate(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    return t.run(select=named(o, "o_custkey"), source=o, group_by=[o.of("o_custkey")], order_by=[fn.count().desc(), fn.sum_(o.of("o_totalprice")).desc(), o.of("o_custkey").asc()], limit=20)


@registered("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_discount > 0.05")
def global_aggregate(spark, sf_dir):
    t = Tables(spark, sf_dir)
    x = t["lineitem"]
    return t.run(select=[fn.count().as_("n"), fn.sum_(x.of("l_linenumber")).as_("lines"), rounded(fn.avg(x.of("l_quantity")), 6).as_("mean")], source=x, where=cr.above(x.of("l_discount"), 0.05))


@registered("SELECT count(*) AS n, max(o_totalprice) AS high FROM orders WHERE o_orderkey < 0")
def global_aggregate_of_nothing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    return t.run(select=[fn.count().as_("n"), fn.max_(o.of("o_totalprice")).as_("high")], source=o, where=cr.below(o.of("o_orderkey"), 0))


@registered("SELECT c_mktsegment || '/' || c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_mktsegment || '/' || c_nationkey")
def group_by_expression(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t["customer"]
    text = declare("as text", function("string", 1))
    k = fn.concat(c.of("c_mktsegment"), "/", apply(text, c.of("c_nationkey"), kind=Kind.TEXT))
    return t.run(select=[k.as_("k"), fn.count().as_("n")], source=c, group_by=[k])


# the whole specification: CTE, having, left join, coalesce, window

WHOLE = """
WITH totals AS (SELECT o_custkey AS customer, COUNT(*) AS lines, SUM(o_totalprice) AS total, MAX(o_totalprice) AS largest
                FROM orders GROUP BY o_custkey HAVING COUNT(*) >= {least})
SELECT c.c_custkey AS customer, COALESCE(s.lines, 0) AS lines, ROUND(COALESCE(s.total, 0), 2) AS total, COALESCE(s.largest, 0) AS largest,
       COUNT(*) OVER (ORDER BY COALESCE(s.lines, 0) DESC) AS ranked
FROM customer c LEFT JOIN totals s ON s.customer = c.c_custkey
"""


def _whole(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    t = Tables(spark, sf_dir)
    o, c = t["orders"], t["customer"].as_("c")
    each = SelectQuery(
        select=[o.of("o_custkey").as_("customer"), fn.count().as_("lines"), fn.sum_(o.of("o_totalprice")).as_("total"), fn.max_(o.of("o_totalprice")).as_("largest")],
        source=o,
        group_by=[o.of("o_custkey")],
        having=cr.at_least(fn.count(), least),
    )
    totals = with_("totals", each)
    s = totals.source().as_("s")
    lines = fn.coalesce(s.of("lines"), 0)
    select = [c.of("c_custkey").as_("customer"), lines.as_("lines"), rounded(fn.coalesce(s.of("total"), 0.0)).as_("total"), fn.coalesce(s.of("largest"), 0.0).as_("largest"), fn.count().over(Window(order_by=[lines.desc()])).as_("ranked")]
    return t.run(with_=[totals], select=select, source=c, joins=[left_join(s, columns_equal(s, "customer", c, "c_custkey"))])


@registered("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O' GROUP BY o_orderpriority")
def composed_statement(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.engine.query(compose("SELECT o_orderpriority, count(*) AS n FROM ", table("orders"), " WHERE o_totalprice > ", bind(100000.0), " AND o_orderstatus = ", bind("O"), " GROUP BY o_orderpriority"))


@registered(WHOLE.format(least=8))
def whole_specification(spark, sf_dir):
    return _whole(spark, sf_dir, 8)


# scalars


@registered("SELECT p_partkey, p_brand || ' / ' || p_type AS label FROM part")
def concat_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t["part"]
    return t.run(select=[*named(p, "p_partkey"), fn.concat(p.of("p_brand"), " / ", p.of("p_type")).as_("label")], source=p)


@registered("SELECT d.doc_id, 'q' || CAST(l.quality AS VARCHAR) AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def concat_null(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d, lab = t["documents"].as_("d"), t["labels"].as_("l")
    text = declare("as text", function("string", 1))
    return t.run(select=[*named(d, "doc_id"), fn.concat("q", apply(text, lab.of("quality"), kind=Kind.TEXT)).as_("label")], source=d, joins=[left_join(lab, columns_equal(d, "doc_id", lab, "doc_id"))])


@registered("SELECT doc_id, substring(text, 3, 7) AS part FROM documents")
def substring_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t["documents"]
    return t.run(select=[*named(d, "doc_id"), fn.substring(d.of("text"), 3, 7).as_("part")], source=d)


@registered("SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, trim('  ' || c_name || '  ') AS plain FROM customer")
def lower_upper_trim(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t["customer"]
    return t.run(select=[*named(c, "c_custkey"), fn.lower(c.of("c_name")).as_("low"), fn.upper(c.of("c_mktsegment")).as_("up"), fn.trim(fn.concat("  ", c.of("c_name"), "  ")).as_("plain")], source=c)


@registered("SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents")
def length_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t["documents"]
    return t.run(select=[*named(d, "doc_id"), fn.length(d.of("text")).as_("n")], source=d)


@registered("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coalesce_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d, lab = t["documents"].as_("d"), t["labels"].as_("l")
    return t.run(select=[*named(d, "doc_id"), fn.coalesce(lab.of("quality"), -1).as_("quality")], source=d, joins=[left_join(lab, columns_equal(d, "doc_id", lab, "doc_id"))])


@registered("SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_quantity + l_tax AS more, l_quantity / 3 AS third FROM lineitem")
def arithmetic(spark, sf_dir):
    t = Tables(spark, sf_dir)
    x = t["lineitem"]
    net = fn.times(x.of("l_extendedprice"), fn.minus(1.0, x.of("l_discount")))
    return t.run(select=[*named(x, "l_orderkey", "l_linenumber", "l_extendedprice"), net.as_("net"), fn.plus(x.of("l_quantity"), x.of("l_tax")).as_("more"), fn.div(x.of("l_quantity"), 3.0).as_("third")], source=x)


@registered("SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS whole, CAST((0 - p_size) // 7 AS BIGINT) AS negative FROM part")
def integer_div(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t["part"]
    return t.run(select=[*named(p, "p_partkey"), fn.div(p.of("p_size"), 7).as_("whole"), fn.div(fn.minus(0, p.of("p_size")), 7).as_("negative")], source=p)


@registered("SELECT event_id, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6 AS gap FROM events")
def seconds_since_first(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = t["events"]
    return t.run(select=[*named(e, "event_id"), fn.seconds(e.of("ts"), fn.min_(e.of("ts")).over(Window([e.of("user_id")]))).as_("gap")], source=e)


# predicates


@registered("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34)")
def in_values(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    return t.run(select=named(o, "o_orderkey"), source=o, where=cr.and_(cr.in_values(o.of("o_orderpriority"), ["1-URGENT", "2-HIGH"]), cr.in_values(o.of("o_orderkey"), [1, 2, 3, 5, 8, 13, 21, 34])))


@registered("SELECT o_orderkey FROM orders WHERE 1 = 0")
def in_empty(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    return t.run(select=named(o, "o_orderkey"), source=o, where=cr.in_values(o.of("o_orderkey"), []))


@registered("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def in_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c, o = t["customer"], t["orders"]
    sub = SelectQuery(select=named(o, "o_custkey"), source=o, where=cr.above(o.of("o_totalprice"), 300000.0))
    return t.run(select=named(c, "c_custkey"), source=c, where=cr.in_query(c.of("c_custkey"), sub))


@registered("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def not_in_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o, x = t["orders"], t["lineitem"]
    return t.run(select=named(o, "o_orderkey"), source=o, where=cr.not_(cr.in_query(o.of("o_orderkey"), SelectQuery(select=named(x, "l_orderkey"), source=x))))


@registered("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 40)")
def exists_correlated(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c, o = t["customer"].as_("c"), t["orders"].as_("o")
    sub = SelectQuery(select=[param(1).as_("one")], source=o, where=cr.and_(columns_equal(o, "o_custkey", c, "c_custkey"), cr.above(o.of("o_totalprice"), fn.times(c.of("c_acctbal"), 40.0))))
    return t.run(select=named(c, "c_custkey"), source=c, where=cr.exists(sub))


@registered("SELECT o_orderkey, o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o.o_orderkey)")
def not_exists(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o, x = t["orders"].as_("o"), t["lineitem"].as_("x")
    sub = SelectQuery(select=[param(1).as_("one")], source=x, where=columns_equal(x, "l_orderkey", o, "o_orderkey"))
    return t.run(select=named(o, "o_orderkey", "o_totalprice"), source=o, where=cr.not_(cr.exists(sub)))


@registered("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'")
def like(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t["part"]
    return t.run(select=named(p, "p_partkey", "p_name"), source=p, where=cr.like(p.of("p_name"), "%a_e%"))


@registered("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[1-3][0-9]?$')")
def regexp(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t["part"]
    return t.run(select=named(p, "p_partkey"), source=p, where=cr.regexp(p.of("p_brand"), "#[1-3][0-9]?$"))


@registered("SELECT d.doc_id, l.toxic IS NULL AS bare FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.toxic IS NOT NULL AND l.toxic = 1")
def is_null(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d, lab = t["documents"].as_("d"), t["labels"].as_("l")
    where = cr.or_(cr.is_null(lab.of("quality")), cr.and_(cr.is_not_null(lab.of("toxic")), cr.equal(lab.of("toxic"), 1)))
    return t.run(select=[*named(d, "doc_id"), cr.is_null(lab.of("toxic")).as_("bare")], source=d, joins=[left_join(lab, columns_equal(d, "doc_id", lab, "doc_id"))], where=where)


@registered("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 250000) AND NOT (o_orderpriority = '5-LOW')")
def junctions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    where = cr.and_(cr.every_row(), cr.or_(cr.equal(o.of("o_orderstatus"), "O"), cr.above(o.of("o_totalprice"), 250000.0)), cr.not_(cr.bracket(cr.equal(o.of("o_orderpriority"), "5-LOW"))), cr.or_(cr.every_row(), cr.no_row()))
    return t.run(select=named(o, "o_orderkey"), source=o, where=where)


# subqueries


@registered("SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AS n FROM customer c")
def scalar_subquery_correlated(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c, o = t["customer"].as_("c"), t["orders"].as_("o")
    sub = SelectQuery(select=[fn.count().as_("n")], source=o, where=cr.and_(columns_equal(o, "o_custkey", c, "c_custkey"), cr.equal(o.of("o_orderstatus"), "P")))
    return t.run(select=[*named(c, "c_custkey"), subquery(sub).as_("n")], source=c)


@registered("SELECT s.seg, s.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) s WHERE s.n > 10")
def derived_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t["customer"]
    s = SelectQuery(select=[c.of("c_mktsegment").as_("seg"), fn.count().as_("n")], source=c, group_by=[c.of("c_mktsegment")]).as_("s")
    return t.run(select=named(s, "seg", "n"), source=s, where=cr.above(s.of("n"), 10))


@registered("WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS customers FROM a GROUP BY n) SELECT x.o_custkey, x.n, b.customers FROM a x JOIN b ON x.n = b.n")
def cte_chain(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    a = with_("a", SelectQuery(select=[*named(o, "o_custkey"), fn.count().as_("n")], source=o, group_by=[o.of("o_custkey")]))
    s = a.source()
    b = with_("b", SelectQuery(select=[*named(s, "n"), fn.count().as_("customers")], source=s, group_by=[s.of("n")]))
    x, y = s.as_("x"), b.source()
    return t.run(with_=[a, b], select=[*named(x, "o_custkey", "n"), *named(y, "customers")], source=x, joins=[inner_join(y, columns_equal(x, "n", y, "n"))])


# windows


@registered("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS so_far, CAST(sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS keys FROM orders")
def window_running_count(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    w = Window([o.of("o_custkey")], [o.of("o_orderdate").asc()])
    w2 = Window([o.of("o_custkey")], [o.of("o_orderdate").asc(), o.of("o_orderkey").asc()])
    return t.run(select=[*named(o, "o_orderkey"), fn.count().over(w).as_("so_far"), fn.sum_(o.of("o_custkey")).over(w2).as_("keys")], source=o)


@registered("SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS best, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def window_partition_total(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    w = Window([o.of("o_custkey")])
    return t.run(select=[*named(o, "o_orderkey"), fn.max_(o.of("o_totalprice")).over(w).as_("best"), fn.count().over(w).as_("n")], source=o)


@registered("SELECT o_orderkey, count(*) OVER (ORDER BY o_orderdate DESC) AS newer, max(o_totalprice) OVER (ORDER BY o_orderstatus, o_orderpriority) AS high, CAST(sum(o_custkey) OVER () AS BIGINT) AS keys FROM orders")
def window_over_all(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    newer = fn.count().over(Window(order_by=[o.of("o_orderdate").desc()]))
    high = fn.max_(o.of("o_totalprice")).over(Window(order_by=[o.of("o_orderstatus").asc(), o.of("o_orderpriority").asc()]))
    return t.run(select=[*named(o, "o_orderkey"), newer.as_("newer"), high.as_("high"), fn.sum_(o.of("o_custkey")).over(Window()).as_("keys")], source=o)


@registered("SELECT d.doc_id, count(*) OVER (ORDER BY l.quality DESC NULLS LAST) AS place FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def window_over_all_nulls(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d, lab = t["documents"].as_("d"), t["labels"].as_("l")
    place = fn.count().over(Window(order_by=[lab.of("quality").desc().nulls_last()]))
    return t.run(select=[*named(d, "doc_id"), place.as_("place")], source=d, joins=[left_join(lab, columns_equal(d, "doc_id", lab, "doc_id"))])


@registered("SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY c_nationkey) AS BIGINT) AS of_nation FROM customer GROUP BY c_nationkey, c_mktsegment")
def window_over_group(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t["customer"]
    return t.run(select=[*named(c, "c_nationkey", "c_mktsegment"), fn.count().as_("n"), fn.sum_(fn.count()).over(Window([c.of("c_nationkey")])).as_("of_nation")], source=c, group_by=[c.of("c_nationkey"), c.of("c_mktsegment")])


@registered("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def declared_row_number(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    w = Window([o.of("o_custkey")], [o.of("o_totalprice").desc(), o.of("o_orderkey").asc()])
    return t.run(select=[*named(o, "o_orderkey"), apply(ROW_NUMBER, kind=Kind.WHOLE).over(w).as_("place")], source=o)


@registered("SELECT c_custkey, upper(c_mktsegment) || '!' AS loud FROM customer")
def operation_overridden(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t["customer"]
    engine = t.engine.also({INITCAP: lambda args, kinds, detail: SF.concat(SF.upper(args[0]), SF.lit("!"))})
    return engine.compile(SelectQuery(select=[*named(c, "c_custkey"), apply(INITCAP, c.of("c_mktsegment"), kind=Kind.TEXT).as_("loud")], source=c))


# paging


def _orders_listing(t: Tables):
    o = t["orders"]
    base = listing(o, "o_orderkey").max_page(1000)
    return base.sort("newest", o.of("o_orderdate").desc()).sort("oldest", o.of("o_orderdate").asc()).sort("mixed", o.of("o_orderstatus").asc(), o.of("o_totalprice").desc())


def _page(t: Tables, lst, **q) -> DataFrame:
    return t.engine.compile(lst.query(PageQuery(**q))[0])


@registered("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' OR o_orderdate = TIMESTAMP '1997-01-01' AND o_orderkey < 5000 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51")
def keyset_after(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lst = _orders_listing(t)
    return _page(t, lst, sort="newest", size=50, after=lst.cursor_at([dt.datetime(1997, 1, 1), 5000], PageQuery(sort="newest")))


@registered("SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' OR o_orderdate = TIMESTAMP '1997-01-01' AND o_orderkey > 5000 ORDER BY o_orderdate, o_orderkey LIMIT 51")
def keyset_before(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lst = _orders_listing(t)
    return _page(t, lst, sort="newest", size=50, before=lst.cursor_at([dt.datetime(1997, 1, 1), 5000], PageQuery(sort="newest")))


@registered("SELECT * FROM orders WHERE o_orderstatus > 'F' OR o_orderstatus = 'F' AND o_totalprice < 100000 OR o_orderstatus = 'F' AND o_totalprice = 100000 AND o_orderkey < 7 ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey DESC LIMIT 41")
def keyset_mixed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lst = _orders_listing(t)
    return _page(t, lst, sort="mixed", size=40, after=lst.cursor_at(["F", 100000.0, 7], PageQuery(sort="mixed")))


def _nullable(t: Tables):
    d, lab = t["documents"].as_("d"), t["labels"].as_("l")
    both = SelectQuery(select=[*named(d, "doc_id"), lab.of("quality").as_("q")], source=d, joins=[left_join(lab, columns_equal(d, "doc_id", lab, "doc_id"))]).as_("r")
    return both, listing(both, "doc_id").max_page(10000).sort("best", both.of("q").desc().nulls_last()).sort("bare", both.of("q").asc().nulls_first())


_NULLABLE = "WITH r AS (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, q FROM r "


@registered(_NULLABLE + "WHERE q < 1 OR q IS NULL OR q = 1 AND doc_id < 20 ORDER BY q DESC NULLS LAST, doc_id DESC LIMIT 501")
def keyset_nulls_last(spark, sf_dir):
    t = Tables(spark, sf_dir)
    _, lst = _nullable(t)
    return _page(t, lst, sort="best", size=500, after=lst.cursor_at([1, 20], PageQuery(sort="best")))


@registered(_NULLABLE + "WHERE q IS NULL AND doc_id < 400 ORDER BY doc_id DESC LIMIT 101")
def keyset_inside_nulls(spark, sf_dir):
    t = Tables(spark, sf_dir)
    _, lst = _nullable(t)
    return _page(t, lst, sort="best", size=100, after=lst.cursor_at([None, 400], PageQuery(sort="best")))


@registered("SELECT d.doc_id, l.quality AS q, count(*) OVER (ORDER BY l.quality ASC NULLS FIRST) AS place FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def nulls_first_over_all(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r, _ = _nullable(t)
    return t.run(select=[*named(r, "doc_id", "q"), fn.count().over(Window(order_by=[r.of("q").asc().nulls_first()])).as_("place")], source=r)


@registered("SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 31 OFFSET 90")
def numbered_page(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _page(t, _orders_listing(t), sort="oldest", size=30, number=4)


@registered("SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 31 OFFSET 90")
def numbered_page_keys_first(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.engine.compile(_orders_listing(t).keys_first(PageQuery(sort="oldest", size=30, number=4)))


@registered("SELECT least(count(*), 1000) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_up_to(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    capped = SelectQuery(select=named(o, "o_orderkey"), source=o, where=cr.equal(o.of("o_orderstatus"), "F"), limit=1000).as_("capped")
    return t.run(select=[fn.count().as_("n")], source=capped)


# search


@registered("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'b')")
def search_prefix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t["part"]
    return t.run(select=named(p, "p_partkey", "p_name"), source=p, where=matches(p, [declare_search("name", ["p_name"], Match.PREFIX)], "name", "B"))


@registered("SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(lang || ' ' || text), '[^\\p{L}\\p{Nd}]+'), 'that') AND list_contains(regexp_split_to_array(lower(lang || ' ' || text), '[^\\p{L}\\p{Nd}]+'), 'en')")
def search_words(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t["documents"]
    return t.run(select=named(d, "doc_id"), source=d, where=matches(d, [declare_search("words", ["lang", "text"], Match.WORDS)], "words", "That, EN!"))


@registered("SELECT doc_id FROM documents WHERE contains(lower(text), 'rights res')")
def search_substring(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t["documents"]
    return t.run(select=named(d, "doc_id"), source=d, where=matches(d, [declare_search("in", ["text"], Match.FRAGMENT)], "in", "RIGHTS res"))


# mapping, writes, evolution


@registered("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer")
def flatten_roundtrip(spark, sf_dir):
    c = Tables(spark, sf_dir).engine.table("customer")
    nested = c.select("c_custkey", SF.struct(SF.col("c_name").alias("name"), SF.struct(SF.col("c_nationkey").alias("nation"), SF.col("c_mktsegment").alias("segment")).alias("place")).alias("who"), "c_acctbal")
    flat = flattened(nested)
    again = flattened(unflattened(flat, nested.schema))
    return again.select("c_custkey", SF.col("who_name").alias("c_name"), SF.col("who_place_nation").alias("c_nationkey"), SF.col("who_place_segment").alias("c_mktsegment"), "c_acctbal")


@registered("SELECT o_orderkey, o_custkey, l_partkey, l_suppkey, l_quantity, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def aggregate_assemble(spark, sf_dir):
    t = Tables(spark, sf_dir).engine
    lines = t.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    whole = assembled(t.table("orders").select("o_orderkey", "o_custkey"), {"lines": (lines, {"l_orderkey": "o_orderkey"}, ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity"])})
    root, parts = taken_apart(whole, ["o_orderkey"], ["lines"])
    return root.join(parts["lines"], "o_orderkey").select("o_orderkey", "o_custkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


@registered("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 900000 + n_nationkey, n_name, n_nationkey, NULL FROM nation")
def insert_result(spark, sf_dir):
    t = Tables(spark, sf_dir).engine
    new = t.table("nation").select((SF.col("n_nationkey") + 900000).cast("bigint").alias("s_suppkey"), SF.col("n_name").alias("s_name"), SF.col("n_nationkey").alias("s_nationkey"))
    return inserted(t.table("supplier"), new)


@registered("SELECT s_suppkey, CASE WHEN s_suppkey <= 25 THEN 'S' || s_suppkey ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 500000 + n_nationkey, 'S' || (500000 + n_nationkey), NULL, NULL FROM nation")
def upsert_result(spark, sf_dir):
    t = Tables(spark, sf_dir).engine
    n = t.table("nation").select(SF.col("n_nationkey").cast("bigint").alias("k"))
    s = t.table("supplier").filter("s_suppkey <= 25").select(SF.col("s_suppkey").alias("k"))
    new = s.unionByName(n.select((SF.col("k") + 500000).alias("k"))).select(SF.col("k").alias("s_suppkey"), SF.concat(SF.lit("S"), SF.col("k").cast("string")).alias("s_name"))
    return upserted(t.table("supplier"), new, ["s_suppkey"])


@registered("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_result(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t["customer"]
    return updated(t.engine, c, {"c_acctbal": 0.0, "c_mktsegment": "DEBT"}, cr.below(c.of("c_acctbal"), 0.0))


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE NOT coalesce(o_totalprice > 100000 AND o_orderstatus = 'F', false)")
def delete_result(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    return deleted(t.engine, o, cr.and_(cr.above(o.of("o_totalprice"), 100000.0), cr.equal(o.of("o_orderstatus"), "F"))).select("o_orderkey", "o_custkey")


def _supplier_history(schema) -> History:
    h = History.start("supplier", "1", schema).then("2", Rename("s_name", "label"), Addition("grade", "string", default="standard"))
    h = h.then("3", Retype("s_nationkey", "bigint"), Removal("s_acctbal"))
    split = Recomputation(
        removed=("label",),
        added=(("head", "string"), ("tail", "string")),
        forward=lambda df: df.withColumn("head", SF.split("label", "#")[0]).withColumn("tail", SF.split("label", "#")[1]),
        back=lambda df: df.withColumn("label", SF.concat_ws("#", "head", "tail")),
    )
    return h.then("4", split)


@registered("SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, 'standard' AS grade, split_part(s_name, '#', 1) AS head, split_part(s_name, '#', 2) AS tail FROM supplier")
def evolve_forward(spark, sf_dir):
    df = Tables(spark, sf_dir).engine.table("supplier")
    return migrate_rows(_supplier_history(df.schema), df, "1", "4")


@registered("SELECT s_suppkey, s_name, s_nationkey, CAST(NULL AS DOUBLE) AS s_acctbal FROM supplier")
def evolve_back(spark, sf_dir):
    df = Tables(spark, sf_dir).engine.table("supplier")
    h = _supplier_history(df.schema)
    return migrate_rows(h, migrate_rows(h, df, "1", "4"), "4", "1")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the whole specification in one query, with a threshold that fits the smallest tables."""
    return _whole(spark, sf_dir, 8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | stored_catalog.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | stored_catalog.oracle_sql()
