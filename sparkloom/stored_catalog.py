"""Registered queries of stores, repositories, collections, derived tables, migrations and pages, each with equivalent SQL.

Each works on a store of its own in the scratch folder, filled from whole tables, and returns what it holds afterwards, or
what a walk through it gives.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as SF
from pyspark.sql import types as T

from sparkloom import functions as fn
from sparkloom.engine import Engine
from sparkloom.kinds import Kind, kind_of
from sparkloom.operators import criteria as cr
from sparkloom.operators.expr import Selection, apply
from sparkloom.operators.listing import Listing, PageQuery, listing
from sparkloom.operators.operations import declare
from sparkloom.operators.order_keys import even_keys, key_between
from sparkloom.operators.positions import placed
from sparkloom.operators.search import Match, declare_search, matches, matches_stored, searchable
from sparkloom.plans.select import SelectQuery
from sparkloom.plans.statement import DeleteQuery, InsertQuery, UpdateQuery, UpsertQuery, bind, compose, table
from sparkloom.refusal import AlreadyThere, BrokenRule, Fault, Irreversible, NoRows, NotInCollection, PageQueryError, Refusal, SeveralRows
from sparkloom.sources import migrate
from sparkloom.sources.collection import FIRST, Collection, after, before
from sparkloom.sources.evolve import Addition, History, Recomputation, Removal, Rename, Retype
from sparkloom.sources.execute import execute
from sparkloom.sources.mapping import arguments_of, columns_of, snake_case
from sparkloom.sources.parquet import ParquetFolder
from sparkloom.sources.repository import Repository, canonical
from sparkloom.sources.store import Store, rows_of
from sparkloom.sources.tables import Field, ForeignKey, Index, Object, Reference, Rule, Scalar, Sequence_, Table, derive

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def registered(sql: str):
    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder for a store: in the shared folder that the session names, or of our own where all is one machine."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told is not None:
        if urlparse(told).scheme not in ("", "file"):
            raise Refusal("a store's manifest needs a file system that can be mounted")
        return os.path.join(unquote(urlparse(told).path), f"store-{uuid.uuid4().hex}")
    if not spark.sparkContext.master.startswith("local"):
        raise Refusal("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="sparkloom-store-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_store(spark: SparkSession) -> Store:
    return Store(spark, scratch(spark))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def described(df: DataFrame, name: str, *key: str, **rules) -> Table:
    return Table(name, tuple((f.name, f.dataType, f.name not in key) for f in df.schema.fields), key, **rules)


def filled(spark: SparkSession, sf_dir: str, **names: tuple) -> Store:
    """A store with whole tables; by name: the key, and references."""
    store = new_store(spark)
    with store.transaction() as t:
        for name, (key, *keys) in names.items():
            df = read(spark, sf_dir, name)
            t.create(described(df, name, key, foreign_keys=tuple(keys)), df)
    return store


def values(rows: Iterable[Sequence], columns: str) -> str:
    """SQL of literal rows."""
    spelled = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(spelled, r)) + ")" for r in rows) + f") AS v({columns})"


# the store

NATION_OF = ForeignKey(("n_regionkey",), "region", ("r_regionkey",), "cascade")
SUPPLIER_OF = ForeignKey(("s_nationkey",), "nation", ("n_nationkey",), "set null")


@registered("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 900000 + n_nationkey, n_name, n_nationkey, NULL FROM nation")
def store_insert(spark, sf_dir):
    store = filled(spark, sf_dir, supplier=("s_suppkey",))
    new = read(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey + 900000 AS BIGINT) AS s_suppkey", "n_name AS s_name", "n_nationkey AS s_nationkey")
    with store.transaction() as t:
        t.insert("supplier", new)
    return store.table("supplier")


@registered("SELECT s_suppkey, 'S' || s_suppkey AS s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT 500000 + n_nationkey, 'N' || n_nationkey, NULL, NULL FROM nation")
def store_upsert(spark, sf_dir):
    store = filled(spark, sf_dir, supplier=("s_suppkey",))
    some = read(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").selectExpr("s_suppkey", "concat('S', s_suppkey) AS s_name")
    new = read(spark, sf_dir, "nation").selectExpr("CAST(500000 + n_nationkey AS BIGINT) AS s_suppkey", "concat('N', n_nationkey) AS s_name")
    with store.transaction() as t:
        t.upsert("supplier", some.unionByName(new))
    return store.table("supplier")


@registered("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN s_name || '!' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def store_update(spark, sf_dir):
    store = filled(spark, sf_dir, supplier=("s_suppkey",))
    s = store.known["supplier"].source()
    execute(store, UpdateQuery(s, ["s_name", "s_acctbal"], [fn.concat(s.of("s_name"), "!"), 0.0], cr.below(s.of("s_acctbal"), 0.0)))
    return store.table("supplier")


@registered("SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE s_nationkey END AS s_nationkey, n_regionkey = 1 AS lost FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def store_delete(spark, sf_dir):
    """A region goes, its nations with it, and their suppliers lose their nation."""
    store = filled(spark, sf_dir, region=("r_regionkey",), nation=("n_nationkey", NATION_OF), supplier=("s_suppkey", SUPPLIER_OF))
    r = store.known["region"].source()
    execute(store, DeleteQuery(r, cr.equal(r.of("r_regionkey"), 1)))
    left = store.table("nation").select(SF.col("n_nationkey").alias("left"))
    s = store.table("supplier")
    return s.join(left, s["s_nationkey"] == left["left"], "left").select("s_suppkey", "s_nationkey", SF.col("left").isNull().alias("lost"))


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5 UNION ALL " + values([(100, "a"), (101, "bb")], "k, n"))
def store_statements(spark, sf_dir):
    store = filled(spark, sf_dir, nation=("n_nationkey",))
    n = store.known["nation"].source()
    execute(store, InsertQuery("nation", ["n_nationkey", "n_name"], [(100, "a"), (101, "b")]))
    execute(store, UpsertQuery("nation", ["n_nationkey", "n_name"], [(101, "bb")], ["n_nationkey"]))
    execute(store, DeleteQuery(n, cr.and_(cr.at_least(n.of("n_nationkey"), 5), cr.below(n.of("n_nationkey"), 100))))
    return store.table("nation").select(SF.col("n_nationkey").cast("bigint"), "n_name")


@registered("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def store_abandoned(spark, sf_dir):
    """A transaction that fails leaves all tables as they were."""
    store = filled(spark, sf_dir, region=("r_regionkey",), nation=("n_nationkey", NATION_OF))
    for broken in (AlreadyThere, BrokenRule):
        try:
            with store.transaction() as t:
                t.delete("region", rows_of(t, "region", [{"r_regionkey": 2}]))
                if broken is AlreadyThere:
                    t.insert("nation", read(spark, sf_dir, "nation"))
                t.upsert("nation", rows_of(t, "nation", [{"n_nationkey": 900, "n_regionkey": 77}]))
        except broken:
            continue
    return store.table("nation").select("n_nationkey", "n_name", "n_regionkey")


@registered("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer")
def clustered_rows(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    return Index(("c_nationkey", "c_custkey")).clustered(c, 4)


# aggregates

ID, TEXT = Scalar("int64"), Scalar("text")
PURCHASE = Object("purchase", (Field("id", ID, identity=True), Field("price", Scalar("number64"))))
BUYER = Object("buyer", (Field("id", ID, identity=True), Field("name", TEXT), Field("segment", Object("segment", (Field("name", TEXT),))), Field("purchases", Sequence_(PURCHASE))))


def _buyers(spark: SparkSession, sf_dir: str) -> Repository:
    repo = Repository(new_store(spark), BUYER)
    repo.create()
    orders = read(spark, sf_dir, "orders").groupBy(SF.col("o_custkey").alias("id")).agg(SF.array_sort(SF.collect_list(SF.struct(SF.col("o_orderkey").cast("bigint").alias("id"), SF.col("o_totalprice").alias("price")))).alias("purchases"))
    c = read(spark, sf_dir, "customer").select(SF.col("c_custkey").alias("id"), SF.col("c_name").alias("name"), SF.struct(SF.col("c_mktsegment").alias("name")).alias("segment"))
    repo.load(c.join(orders, "id", "left").select(SF.col("id").cast("bigint").alias("id"), "name", "segment", "purchases"))
    return repo


@registered("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, o_orderkey AS purchase, o_totalprice AS price, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS place FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def repository_nested(spark, sf_dir):
    """Aggregates loaded from nested rows into their tables, and read back nested."""
    whole = _buyers(spark, sf_dir).nested()
    rows = whole.select("id", "name", SF.col("segment.name").alias("segment"), SF.posexplode_outer("purchases").alias("place", "p"))
    return rows.select("id", "name", "segment", SF.col("p.id").alias("purchase"), SF.col("p.price").alias("price"), SF.coalesce("place", SF.lit(0)).cast("bigint").alias("place"))


@registered("SELECT o_custkey AS buyer_id, o_orderkey AS id, o_totalprice AS price, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 1024 AS BIGINT) AS position FROM orders JOIN customer ON c_custkey = o_custkey")
def repository_rows(spark, sf_dir):
    return _buyers(spark, sf_dir).store.table("purchase").select("buyer_id", "id", "price", SF.col("position").cast("bigint"))


LAND = Object("land", (Field("id", ID, identity=True), Field("name", TEXT)))
REALM = Object("realm", (Field("id", ID, identity=True), Field("name", Scalar("text", (Rule("max_length", 30),)), unique=True), Field("lands", Sequence_(LAND)), Field("friends", Sequence_(Reference("friend")))))
FRIEND = Object("friend", (Field("id", ID, identity=True),))


def _realms(spark: SparkSession, sf_dir: str) -> Repository:
    """Regions with their nations, in order of their keys; friends are numbers."""
    repo = Repository(new_store(spark), REALM, FRIEND)
    repo.create()
    with repo.store.transaction() as t:
        t.insert("friend", spark.range(3).toDF("id"))
    n = read(spark, sf_dir, "nation").groupBy(SF.col("n_regionkey").alias("id")).agg(SF.array_sort(SF.collect_list(SF.struct(SF.col("n_nationkey").cast("bigint").alias("id"), SF.col("n_name").alias("name")))).alias("lands"))
    r = read(spark, sf_dir, "region").select(SF.col("r_regionkey").alias("id"), SF.col("r_name").alias("name"))
    repo.load(r.join(n, "id").select(SF.col("id").cast("bigint").alias("id"), "name", "lands", SF.array(SF.lit(2).cast("bigint"), SF.lit(0).cast("bigint")).alias("friends")))
    return repo


def _lands(repo: Repository) -> DataFrame:
    whole = repo.nested()
    return whole.select(SF.col("id").alias("realm"), SF.col("name").alias("of"), SF.posexplode("lands").alias("place", "l")).select("realm", "of", SF.col("place").cast("bigint").alias("place"), SF.col("l.id").alias("land"), SF.col("l.name").alias("name"))


_LANDS = "SELECT CAST(n_regionkey AS BIGINT) AS realm, {of} AS of, row_number() OVER (PARTITION BY n_regionkey ORDER BY {order}) - 1 AS place, CAST(n_nationkey AS BIGINT) AS land, {name} AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE {where}"


def _sql(of="r_name", order="n_nationkey", name="n_name", where="true") -> str:
    return _LANDS.format(of=of, order=order, name=name, where=where)


def _reversed(value: dict) -> dict:
    return {**value, "lands": value["lands"][::-1]}


@registered(_sql(of="CASE WHEN r_regionkey = 3 THEN 'renamed' ELSE r_name END", order="CASE WHEN n_regionkey = 2 THEN -n_nationkey ELSE n_nationkey END"))
def repository_save(spark, sf_dir):
    """Whole aggregates saved by difference: one with its list turned round, one with another name."""
    repo = _realms(spark, sf_dir)
    repo.save(_reversed(repo.find(2)))
    repo.save_root({"id": 3, "name": "renamed", "lands": [], "friends": []})
    return _lands(repo)


@registered(_sql(name="CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1) THEN 'new' ELSE n_name END", where="n_regionkey <> 4"))
def repository_changes(spark, sf_dir):
    """A change saved without reading, and an aggregate that goes with all beneath it."""
    repo = _realms(spark, sf_dir)
    old = repo.find(1)
    repo.save_changes(old, {**old, "lands": [{**old["lands"][0], "name": "new"}, *old["lands"][1:]]})
    repo.delete(4)
    return _lands(repo)


@registered(_sql() + " UNION ALL " + values([(77, "far", 0, 5, "x"), (77, "far", 1, 3, "y")], "a, b, c, d, e"))
def repository_insert(spark, sf_dir):
    repo = _realms(spark, sf_dir)
    repo.insert({"id": 77, "name": "far", "lands": [{"id": 5, "name": "x"}, {"id": 3, "name": "y"}], "friends": [1]})
    return _lands(repo)


@registered("SELECT CAST(r_regionkey AS BIGINT) AS id, count(*) AS lands, CAST(2 AS BIGINT) AS friend FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name < 'B' OR r_regionkey = 4 GROUP BY r_regionkey")
def repository_find(spark, sf_dir):
    repo = _realms(spark, sf_dir)
    found = [*repo.find_by(cr.below(repo.source().of("name"), "B")), repo.find_one_by(SF.col("id") == 4)]
    return spark.createDataFrame(sorted({(v["id"], len(v["lands"]), v["friends"][0]) for v in found}), "id long, lands long, friend long")


@registered(values([("unchanged", 0), ("one of many moved", 1), ("a leaf", 1), ("the root", 1), ("a reference gone", 1)], "what, writes"))
def repository_writes(spark, sf_dir):
    """How many layers saving writes."""
    repo = _realms(spark, sf_dir)
    v = repo.find(0)
    moved = {**v, "lands": [*v["lands"][1:], v["lands"][0]]}
    leaf = {**moved, "lands": [{**moved["lands"][0], "name": "leaf"}, *moved["lands"][1:]]}
    root = {**leaf, "name": "root"}
    out = [("unchanged", repo.save(v)), ("one of many moved", repo.save(moved)), ("a leaf", repo.save(leaf)), ("the root", repo.save(root)), ("a reference gone", repo.save({**root, "friends": [2]}))]
    return spark.createDataFrame(out, "what string, writes long")


@registered("SELECT (row_number() OVER (ORDER BY r_name DESC) - 1) // 2 AS page, CAST(r_regionkey AS BIGINT) AS id, count(*) AS lands FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def repository_pages(spark, sf_dir):
    """Whole aggregates of every page of a listing."""
    repo = _realms(spark, sf_dir)
    lst = repo.listing().page_size(2).sort("name", repo.source().of("name").desc())
    engine, out, q = Engine(spark, repo.store), [], PageQuery()
    for k in range(100):
        page = repo.page(engine, lst, q)
        out += [(k, v["id"], len(v["lands"])) for v in page.items]
        if not page.next:
            break
        q = PageQuery(after=page.next)
    return spark.createDataFrame(out, "page long, id long, lands long")


@registered(values([("unchanged", True), ("whole and float", True), ("truth and one", True), ("text and bytes", True), ("other text", False)], "what, same"))
def row_equality(spark, sf_dir):
    pairs = [("unchanged", [1, None], [1, None]), ("whole and float", 2, 2.0), ("truth and one", {"a": True}, {"a": 1}), ("text and bytes", "x", b"x"), ("other text", "x", "X")]
    return spark.createDataFrame([(w, canonical(a) == canonical(b)) for w, a, b in pairs], "what string, same boolean")


# collections


@registered(values([(0, 9), (1, 4), (2, 2), (3, 7), (4, 1), (5, 3)], "place, nation"))
def collection_placed(spark, sf_dir):
    """Nations put into a region's collection one by one, first, last, before and after others, moved and removed."""
    store = filled(spark, sf_dir, region=("r_regionkey",), nation=("n_nationkey",))
    c = Collection(store, store.known["region"], "visited", store.known["nation"])
    c.create()
    with store.transaction():  # one commit for all
        for n in (1, 2, 3, 8):
            c.insert(0, n)
        c.insert(0, 4, FIRST)
        c.insert(0, 7, before(3))
        c.insert(0, 9, before(4))
        c.move(0, 1, after(7))
        c.remove(0, 8)
    page = c.listing(0).page(Engine(spark, store), PageQuery(sort="placed"))
    return spark.createDataFrame([(i, r["nation_n_nationkey"]) for i, r in enumerate(page.items)], "place long, nation long")


@registered("SELECT CAST(n_nationkey AS BIGINT) AS nation, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")
def order_keys_rise(spark, sf_dir):
    """Nations by order keys that were made last to first, each between its neighbours."""
    nations = sorted(r[0] for r in read(spark, sf_dir, "nation").select("n_nationkey").collect())
    keys = even_keys(2)
    low, high = keys
    made = []
    for n in reversed(nations):
        high = key_between(low, high)
        made.append((n, high))
    ranked = {k: i for i, k in enumerate(sorted(k for _, k in made))}
    return spark.createDataFrame([(n, ranked[k]) for n, k in made], "nation long, place long")


@registered(values([("moved", 0, 0), ("moved", 1, 1024), ("moved", 2, 4096), ("added", 0, 0), ("added", 1, 1024), ("added", 2, 2048), ("no room", 0, 0), ("no room", 1, 1024), ("no room", 2, 2048)], "what, place, position"))
def positions_kept(spark, sf_dir):
    cases = [("moved", [3072, 1024, 4096]), ("added", [0, 1024, None]), ("no room", [5, None, 6])]
    return spark.createDataFrame([(w, i, p) for w, stored in cases for i, p in enumerate(placed(stored))], "what string, place long, position long")


# descriptions


@registered(
    values(
        [("land", "realm_id", "bigint", False), ("land", "id", "bigint", False), ("land", "name", "string", False), ("land", "position", "int", False), ("realm", "id", "bigint", False), ("realm", "name", "string", False), ("realm_friends", "realm_id", "bigint", False), ("realm_friends", "friend_id", "bigint", False), ("realm_friends", "position", "int", False), ("friend", "id", "bigint", False)],
        "tab, col, kind, optional",
    )
)
def derived_tables(spark, sf_dir):
    return spark.createDataFrame([(n, c, k.simpleString(), null) for n, t in derive(REALM, FRIEND).items() for c, k, null in t.columns], "tab string, col string, kind string, optional boolean")


@registered(values([("land", "key", "realm_id,id"), ("realm", "key", "id"), ("realm_friends", "key", "realm_id,friend_id"), ("friend", "key", "id"), ("realm", "unique", "name"), ("realm", "check", "name max_length 30"), ("land", "refers", "realm_id realm cascade"), ("realm_friends", "refers", "realm_id realm cascade"), ("realm_friends", "refers", "friend_id friend restrict")], "tab, what, rule"))
def derived_rules(spark, sf_dir):
    out = []
    for n, t in derive(REALM, FRIEND).items():
        out.append((n, "key", ",".join(t.key)))
        out += [(n, "unique", ",".join(u)) for u in t.unique]
        out += [(n, "check", f"{c.column} {c.rule.name} {c.rule.value}") for c in t.checks]
        out += [(n, "refers", f"{','.join(k.columns)} {k.table} {k.on_delete}") for k in t.foreign_keys]
    return spark.createDataFrame(out, "tab string, what string, rule string")


@registered(values([("key",), ("required",), ("check",), ("unique",), ("reference",), ("twice",)], "broken"))
def rules_enforced(spark, sf_dir):
    """Which broken rules a store refuses to commit."""
    repo, out = _realms(spark, sf_dir), []
    lands = lambda *rows: [{"id": i, "name": n} for i, n in rows]
    wrong = {
        "key": lambda: repo.insert({"id": 1, "name": "other", "lands": [], "friends": []}),
        "required": lambda: repo.save({"id": 60, "name": "n", "lands": lands((1, None)), "friends": []}),
        "check": lambda: repo.save({"id": 61, "name": "x" * 31, "lands": [], "friends": []}),
        "unique": lambda: repo.save({"id": 62, "name": repo.find(1)["name"], "lands": [], "friends": []}),
        "reference": lambda: repo.save({"id": 63, "name": "p", "lands": [], "friends": [99]}),
        "twice": lambda: repo.save({"id": 64, "name": "q", "lands": lands((1, "a"), (1, "b")), "friends": []}),
    }
    for name, work in wrong.items():
        try:
            work()
        except (AlreadyThere, BrokenRule, Refusal):
            out.append((name,))
    return spark.createDataFrame(out, "broken string")


@registered(values([("id", "text"), ("name", "text"), ("total", "number"), ("n", "whole"), ("seen", "moment"), ("raw", "bytes"), ("whole", "document"), ("price", "unknown")], "col, kind"))
def kinds_of_types(spark, sf_dir):
    schema = T.StructType.fromDDL("id string, name varchar(9), total double, n int, seen timestamp, raw binary, whole array<int>, price decimal(9,2)")
    return spark.createDataFrame([(f.name, kind_of(f.dataType).value) for f in schema.fields], "col string, kind string")


@registered(values([("poster", "1"), ("home_port_city", "Kiel"), ("home_port_zip_code", None)], "col, value"))
def flattened_arguments(spark, sf_dir):
    schema = T.StructType.fromDDL("poster int, homePort struct<city: string, zipCode: string>")
    args = arguments_of(schema, {"poster": 1, "homePort": {"city": "Kiel", "zipCode": None}})
    named = [snake_case(c) for c in columns_of(schema)]
    return spark.createDataFrame([(c, None if v is None else str(v)) for c, v in zip(named, args, strict=True)], "col string, value string")


# histories


def _history(schema: T.StructType) -> History:
    h = History.start("supplier", "1", schema).then("2", Rename("s_name", "label"), Addition("grade", "string", default="standard"))
    split = Recomputation(("label",), (("head", "string"), ("tail", "string")), lambda d: d.withColumn("head", SF.split("label", "#")[0]).withColumn("tail", SF.split("label", "#")[1]), lambda d: d.withColumn("label", SF.concat_ws("#", "head", "tail")))
    return h.then("3", Retype("s_nationkey", "bigint"), Removal("s_acctbal")).then("4", split)


def _migrated(spark: SparkSession, sf_dir: str, *targets: str) -> Store:
    store = filled(spark, sf_dir, supplier=("s_suppkey",))
    own = store.known["supplier"]
    plan = lambda v: [migrate.Plan(_history(own.schema()), own, v)]
    with store.transaction() as t:  # it is there already, at its first version
        t.create(migrate.ledger_table())
        t.insert(migrate.LEDGER, rows_of(t, migrate.LEDGER, [{"aggregate": "supplier", "version": "1"}]))
    for v in targets:
        migrate.apply(store, plan(v))
    return store


@registered("SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, 'standard' AS grade, split_part(s_name, '#', 1) AS head, split_part(s_name, '#', 2) AS tail FROM supplier")
def migrated_table(spark, sf_dir):
    return _migrated(spark, sf_dir, "4").table("supplier")


@registered("SELECT s_suppkey, s_name, s_nationkey, CAST(NULL AS DOUBLE) AS s_acctbal FROM supplier")
def migrated_back(spark, sf_dir):
    return _migrated(spark, sf_dir, "4", "1").table("supplier")


@registered(values([("supplier", "3")], "aggregate, version"))
def migration_ledger(spark, sf_dir):
    return _migrated(spark, sf_dir, "2", "3").table(migrate.LEDGER)


@registered(values([("valid", None), ("other type", "supplier.s_name is described as int, its history says string"), ("extra", "supplier is described with more, which its history doesn't have")], "what, told"))
def history_validated(spark, sf_dir):
    schema = T.StructType.fromDDL("s_suppkey bigint, s_name string")
    h = History.start("supplier", "1", schema)
    cases = [("valid", schema), ("other type", T.StructType.fromDDL("s_suppkey bigint, s_name int")), ("extra", T.StructType.fromDDL("s_suppkey bigint, s_name string, more int"))]
    return spark.createDataFrame([(w, h.validate(s)) for w, s in cases], "what string, told string")


# pages


def _customers(spark: SparkSession, sf_dir: str) -> tuple[Engine, Listing]:
    folder = ParquetFolder(spark, sf_dir)
    n = folder.source("nation")
    return Engine(spark, folder), listing(n, "n_nationkey").page_size(7).max_page(9).sort("region", n.of("n_regionkey").desc(), n.of("n_name").asc()).indexed_by("n_name")


def _walk(spark, engine: Engine, lst: Listing, size: int = 0, back: bool = False) -> DataFrame:
    """Every page's rows by the cursors that pages give: forward, or back from the last."""
    out, q, k = [], PageQuery(size=size), 0
    page = lst.page(engine, q)
    if back:
        while page.next:
            page = lst.page(engine, PageQuery(size=size, after=page.next))
        last = page.items[-1]
        out.append((0, last["n_nationkey"]))
        q = PageQuery(size=size, before=lst.cursor_at([last["n_regionkey"], last["n_name"], last["n_nationkey"]]))
        page, k = lst.page(engine, q), 1
    while page.items:
        out += [(k, r["n_nationkey"]) for r in page.items]
        onward = page.previous if back else page.next
        if not onward:
            break
        page, k = lst.page(engine, PageQuery(size=size, before=onward) if back else PageQuery(size=size, after=onward)), k + 1
    return spark.createDataFrame(out, "page long, nation long")


@registered("SELECT (row_number() OVER (ORDER BY n_regionkey DESC, n_name, n_nationkey) - 1) // 7 AS page, CAST(n_nationkey AS BIGINT) AS nation FROM nation")
def pages_forward(spark, sf_dir):
    return _walk(spark, *_customers(spark, sf_dir))


@registered("SELECT (row_number() OVER (ORDER BY n_regionkey, n_name DESC, n_nationkey DESC) + 2) // 4 AS page, CAST(n_nationkey AS BIGINT) AS nation FROM nation")
def pages_back(spark, sf_dir):
    return _walk(spark, *_customers(spark, sf_dir), size=4, back=True)


@registered("SELECT (row_number() OVER (ORDER BY n_regionkey DESC, n_name, n_nationkey) - 1) // 3 AS page, CAST(n_nationkey AS BIGINT) AS nation FROM nation WHERE n_regionkey <> 2")
def pages_within(spark, sf_dir):
    engine, lst = _customers(spark, sf_dir)
    return _walk(spark, engine, lst.within(cr.not_equal(lst.source.of("n_regionkey"), 2)).page_size(3))


@registered("SELECT 'all' AS what, count(*) AS n FROM nation UNION ALL SELECT 'some', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'up to 9', least(9, count(*)) FROM nation UNION ALL SELECT 'up to 900', least(900, count(*)) FROM nation")
def listing_counts(spark, sf_dir):
    engine, lst = _customers(spark, sf_dir)
    some = cr.equal(lst.source.of("n_regionkey"), 1)
    out = [("all", lst.count(engine)), ("some", lst.count(engine, some)), ("up to 9", lst.count_up_to(engine, 9)), ("up to 900", lst.count_up_to(engine, 900))]
    return spark.createDataFrame(out, "what string, n long")


@registered(values([(0, "n_name"), (1, "n_nationkey,n_regionkey,n_name")], "place, cols"))
def listing_indexes(spark, sf_dir):
    engine, lst = _customers(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(",".join(c) for c in lst.within(cr.equal(lst.source.of("n_nationkey"), 3)).indexes())), "place long, cols string")


# searches, rows one by one, refusals


@registered("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'b') OR list_contains(regexp_split_to_array(lower(p_name || ' ' || p_brand), '[^\\p{L}\\p{Nd}]+'), 'red')")
def search_stored(spark, sf_dir):
    own = [declare_search("name", ["p_name"], Match.PREFIX), declare_search("all", ["p_name", "p_brand"], Match.WORDS)]
    p = searchable(read(spark, sf_dir, "part"), own)
    return p.filter(matches_stored(own[0], "B") | matches_stored(own[1], "Red")).select("p_partkey", "p_name")


@registered("SELECT n_nationkey FROM nation")
def search_without_words(spark, sf_dir):
    """An empty text, or one without a word, restricts nothing."""
    folder = ParquetFolder(spark, sf_dir)
    n = folder.source("nation")
    own = [declare_search("words", ["n_name"], Match.WORDS), declare_search("start", ["n_name"], Match.PREFIX)]
    where = cr.and_(matches(n, own, "words", " -- "), matches(n, own, "start", ""))
    return Engine(spark, folder).compile(SelectQuery(select=[Selection(n.of("n_nationkey"), "n_nationkey")], source=n, where=where))


@registered("SELECT r_regionkey, r_name FROM region")
def rows_pulled(spark, sf_dir):
    folder = ParquetFolder(spark, sf_dir)
    r = folder.source("region")
    q = SelectQuery(select=[Selection(r.of(c), c) for c in ("r_regionkey", "r_name")], source=r)
    return spark.createDataFrame([tuple(x) for x in Engine(spark, folder).rows(q)], "r_regionkey int, r_name string")


@registered("SELECT 'row' AS what, count(*) AS n FROM orders UNION ALL SELECT 'query row', count(*) FROM orders WHERE o_orderkey > 7 UNION ALL SELECT 'column equals', count(*) FROM nation WHERE n_regionkey = 1")
def one_row(spark, sf_dir):
    folder = ParquetFolder(spark, sf_dir)
    e, o, n = Engine(spark, folder), folder.source("orders"), folder.source("nation")
    counted = SelectQuery(select=[fn.count().as_("n")], source=o)
    same = SelectQuery(select=[fn.count().as_("n")], source=n, where=cr.column_equals("n_regionkey", 1))
    out = [("row", e.row(counted)["n"]), ("query row", e.query_row(compose("SELECT count(*) AS n FROM ", table("orders"), " WHERE o_orderkey > ", bind(7)))["n"]), ("column equals", e.row(same)["n"])]
    return spark.createDataFrame(out, "what string, n long")


@registered(values([("a ? b ?", 2), ("WHERE x = ?", 1)], "said, bound"))
def statement_texts(spark, sf_dir):
    said = [compose("a ", bind(1), " b ", bind("x")), compose("x = ", bind(2.5)).with_prefix("WHERE ")]
    return spark.createDataFrame([(s.text, len(s.values)) for s in said], "said string, bound long")


_REFUSED = [
    "no selection", "no source", "unknown column", "kinds apart", "unknown operation", "not grouped", "offset below zero", "no row", "several rows", "page too large", "page of two kinds", "unknown sort", "cursor of another sort", "cursor of another filter", "broken cursor",
    "unknown search", "search in a language", "search over a query", "unbound value", "statement without rows", "irreversible", "unknown version", "no element", "unknown rule",
]


@registered(values([(x,) for x in _REFUSED], "refused"))
def refusals(spark, sf_dir):
    """Which faulty specifications are refused, each before Spark runs anything of it."""
    folder = ParquetFolder(spark, sf_dir)
    e, n = Engine(spark, folder), folder.source("nation")
    key, name = n.of("n_nationkey"), n.of("n_name")
    one = [Selection(key, "k")]
    lst = listing(n, "n_nationkey").max_page(9).sort("name", name.asc()).sort("key", key.asc())
    derived = SelectQuery(select=one, source=n).as_("d")
    h = History.start("a", "1", T.StructType.fromDDL("x int")).then("2", Recomputation(("x",), (("y", "int"),), lambda d: d.withColumn("y", SF.col("x")), None))
    there = lst.cursor_at(["A", 1], PageQuery(sort="name"))
    unknown = declare("teleport", lambda args, kinds, detail: (_ for _ in ()).throw(Refusal("nobody knows how")))
    own = [declare_search("s", ["n_name"], Match.WORDS, "german")]
    faults = {
        "no selection": lambda: e.compile(SelectQuery(select=[], source=n)),
        "no source": lambda: e.compile(SelectQuery(select=one, source=None)),
        "unknown column": lambda: e.compile(SelectQuery(select=[Selection(n.of("nope"), "x")], source=n)),
        "kinds apart": lambda: e.compile(SelectQuery(select=one, source=n, where=cr.equal(name, 5))),
        "unknown operation": lambda: e.compile(SelectQuery(select=[apply(unknown, key, kind=Kind.WHOLE).as_("t")], source=n)),
        "not grouped": lambda: e.compile(SelectQuery(select=[*one, fn.count().as_("c")], source=n, group_by=[name])),
        "offset below zero": lambda: lst.page(e, PageQuery(number=-1)),
        "no row": lambda: e.row(SelectQuery(select=one, source=n, where=cr.below(key, -1))),
        "several rows": lambda: e.row(SelectQuery(select=one, source=n)),
        "page too large": lambda: lst.page(e, PageQuery(size=10)),
        "page of two kinds": lambda: lst.page(e, PageQuery(number=2, after=there)),
        "unknown sort": lambda: lst.page(e, PageQuery(sort="nope")),
        "cursor of another sort": lambda: lst.page(e, PageQuery(sort="key", after=there)),
        "cursor of another filter": lambda: lst.page(e, PageQuery(sort="name", after=there, where=cr.above(key, 3))),
        "broken cursor": lambda: lst.page(e, PageQuery(sort="name", after=there[:-4])),
        "unknown search": lambda: e.compile(SelectQuery(select=one, source=n, where=matches(n, own, "t", "x"))),
        "search in a language": lambda: e.compile(SelectQuery(select=one, source=n, where=matches(n, own, "s", "x"))),
        "search over a query": lambda: e.compile(SelectQuery(select=[Selection(derived.of("k"), "k")], source=derived, where=matches(derived, own, "s", "x"))),
        "unbound value": lambda: e.query(compose("SELECT ", bind(object()))),
        "statement without rows": lambda: execute(new_store(spark), InsertQuery("t", [], [])),
        "irreversible": lambda: h.between("2", "1"),
        "unknown version": lambda: h.between("1", "9"),
        "no element": lambda: _absent(spark, sf_dir),
        "unknown rule": lambda: Rule("odd", 1).holds(SF.col("x")),
    }
    out = []
    for what, work in faults.items():
        try:
            work()
        except (Refusal, PageQueryError, NoRows, SeveralRows, Irreversible, NotInCollection, Fault):
            out.append((what,))
    return spark.createDataFrame(out, "refused string")


def _absent(spark: SparkSession, sf_dir: str) -> None:
    store = filled(spark, sf_dir, region=("r_regionkey",), nation=("n_nationkey",))
    c = Collection(store, store.known["region"], "seen", store.known["nation"])
    c.create()
    c.move(0, 3, FIRST)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
