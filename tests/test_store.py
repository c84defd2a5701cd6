"""The store, repositories, collections, derivation, evolution and migration on small values."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import functions as fn
from sparkloom.engine import Engine
from sparkloom.operators import criteria as cr
from sparkloom.operators.listing import PageQuery
from sparkloom.operators.order_keys import LONGEST, even_keys, key_between
from sparkloom.operators.positions import GAP, placed, rising
from sparkloom.operators.search import Match, declare_search, matches_stored, searchable, unsearchable
from sparkloom.plans.statement import DeleteQuery, InsertQuery, UpdateQuery, UpsertQuery, bind, compose, table
from sparkloom.refusal import AlreadyThere, BrokenRule, Conflict, Irreversible, NoRows, NotInCollection, Refusal, SeveralRows
from sparkloom.sources import migrate
from sparkloom.sources.collection import FIRST, LAST, Collection, after, before
from sparkloom.sources.evolve import Addition, History, Recomputation, Removal, Rename, Retype, migrate_rows, migrate_value
from sparkloom.sources.execute import execute
from sparkloom.sources.mapping import arguments_of, columns_of, flattened, snake_case, unflattened
from sparkloom.sources.repository import Repository
from sparkloom.sources.store import Snapshot, Store, locked, rows_of, transact
from sparkloom.sources.tables import Field, ForeignKey, Index, Object, Reference, Rule, Scalar, Sequence_, Table, derive, join_by_key
from sparkloom.sources.writes import upserted

ID, TEXT, INT = Scalar("int64"), Scalar("text"), Scalar("int32")
LEG = Object("leg", (Field("id", ID, identity=True), Field("harbour", TEXT), Field("miles", Scalar("int32", (Rule("at_least", 1),)))))
VESSEL = Object("vessel", (Field("id", ID, identity=True), Field("sign", TEXT)))
SAILOR = Object("sailor", (Field("id", ID, identity=True), Field("name", Scalar("text", (Rule("max_length", 20),)), unique=True)))
PLACE = Object("place", (Field("city", TEXT), Field("zip", TEXT)))
VOYAGE = Object("voyage", (Field("id", ID, identity=True), Field("name", TEXT), Field("berth", PLACE, optional=True), Field("legs", Sequence_(LEG)), Field("vessel", VESSEL, optional=True), Field("crew", Sequence_(Reference("sailor")))))


@given(st.lists(st.integers(0, 400), max_size=30))
def test_order_keys_stay_in_order(places):
    keys = even_keys(3)
    for p in places:
        i = p % (len(keys) + 1)
        low, high = keys[i - 1] if i else None, keys[i] if i < len(keys) else None
        keys.insert(i, key_between(low, high))
    assert keys == sorted(keys) and len(set(keys)) == len(keys) and not any(k.endswith("0") for k in keys)


def test_order_keys_in_one_gap():
    low, high = even_keys(2)
    for _ in range(100):
        high = key_between(low, high)
        assert low < high
    assert len(high) <= LONGEST
    ends = [key_between(None, None)]
    for _ in range(300):
        ends = [key_between(None, ends[0]), *ends, key_between(ends[-1], None)]
    assert ends == sorted(set(ends)) and max(map(len, ends)) <= 8
    for n in (0, 1, 61, 500):
        keys = even_keys(n)
        assert keys == sorted(set(keys)) and len(keys) == n
    with pytest.raises(Refusal):
        key_between("b", "a")


@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), max_size=20))
def test_positions_rise_and_keep_the_longest_run(stored):
    out = placed(stored)
    assert all(a < b for a, b in zip(out, out[1:], strict=False))
    assert rising(out) == list(range(len(out)))


def test_moving_one_of_many_changes_one_position():
    stored = [i * GAP for i in range(5000)]
    moved = [stored[4000], *stored[:4000], *stored[4001:]]
    assert sum(a != b for a, b in zip(placed(moved), moved, strict=True)) == 1
    assert sum(a != b for a, b in zip(placed([*stored, None]), [*stored, None], strict=True)) == 1


def test_derivation():
    t = derive(VOYAGE, SAILOR)
    assert list(t) .index("voyage") < list(t).index("leg") and t["leg"].key == ("voyage_id", "id")
    assert [c[0] for c in t["voyage"].columns] == ["id", "name", "berth_city", "berth_zip"] and t["voyage"].columns[2][2]
    assert t["vessel"].single and t["vessel"].unique == (("voyage_id",),) and "position" not in [c[0] for c in t["vessel"].columns]
    assert [c[0] for c in t["voyage_crew"].columns] == ["voyage_id", "sailor_id", "position"]
    assert "NOT NULL" in t["leg"].statement() and "on delete cascade" in t["leg"].statement()
    with pytest.raises(Refusal) as e:
        derive(Object("bare", (Field("a", TEXT), Field("r", Reference("nobody")), Field("u", Scalar("uint64")))))
    assert len(e.value.reasons) >= 3
    assert Scalar("int64", (Rule("at_least", 0), Rule("at_most", 100))).data_type() == T.ByteType()
    assert Scalar("uint64", (Rule("at_most", 1000),)).data_type() == T.ShortType() and Scalar("uint32").data_type() == T.LongType()
    assert snake_case("secondHarbour") == "second_harbour" and snake_case("HTTPPort") == "http_port"
    with pytest.raises(Refusal, match="0 references"):
        join_by_key(t["sailor"], t["sailor"].source(), t["vessel"], t["vessel"].source())


def test_nullable_value_object_round_trip(spark):
    schema = "id long, art struct<poster:string,back:struct<a:long,b:long>>"
    df = spark.createDataFrame([(1, ("p", (1, None))), (2, None), (3, (None, (None, None)))], schema)
    flat = flattened(df)
    assert flat.columns == ["id", "art_poster", "art_back_a", "art_back_b"]
    got = {r["id"]: r["art"] for r in unflattened(flat, df.schema).collect()}
    assert got[2] is None and got[3] is None and got[1]["back"]["a"] == 1
    assert flattened(df, documents=["art"]).columns == ["id", "art"]
    assert columns_of(df.schema) == flat.columns
    assert arguments_of(df.schema, {"id": 1, "art": {"poster": "p", "back": None}}) == [1, "p", None, None]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def leg(i, harbour=None, miles=10):
    return {"id": i, "harbour": harbour or f"t{i}", "miles": miles}


@pytest.fixture
def voyages(store):
    repo = Repository(store, VOYAGE, SAILOR)
    repo.create()
    with store.transaction() as t:
        t.insert("sailor", rows_of(t, "sailor", [{"id": i, "name": f"n{i}"} for i in (1, 2, 3)]))
    return repo


def test_aggregate_life(voyages):
    value = {"id": 1, "name": "one", "berth": None, "legs": [leg(1), leg(2), leg(3)], "vessel": {"id": 9, "sign": "c"}, "crew": [2, 1]}
    assert voyages.save(value) == 4 and voyages.find(1) == value
    assert voyages.save(value) == 0
    changed = {**value, "name": "uno", "legs": [leg(3), leg(1, "new"), leg(4)], "vessel": None, "crew": [1, 2, 3]}
    assert voyages.save(changed) <= 6 and voyages.find(1) == changed
    leaf = {**changed, "legs": [leg(3), leg(1, "newer"), leg(4)]}
    assert voyages.save_changes(changed, leaf) == 1 and voyages.find(1) == leaf
    assert voyages.save_root({"id": 1, "name": "root", "legs": [], "crew": []}) == 1 and voyages.find(1)["legs"] == leaf["legs"]
    voyages.insert({"id": 2, "name": "two", "legs": [leg(1)], "crew": []})
    assert [v["id"] for v in voyages.find_by(cr.above(voyages.source().of("id"), 0))] == [1, 2]
    assert voyages.find_one_by(F.col("name") == "two")["legs"] == [leg(1)]
    with pytest.raises(SeveralRows):
        voyages.find_one_by(F.col("id") > 0)
    with pytest.raises(AlreadyThere):
        voyages.insert({"id": 2, "name": "again", "legs": [], "crew": []})
    assert voyages.delete(1) == 1 and voyages.store.table("leg").count() == 1
    with pytest.raises(NoRows):
        voyages.find(1)
    assert voyages.check() == []


def test_rules_hold(voyages):
    with pytest.raises(BrokenRule):
        voyages.save({"id": 5, "name": "x", "legs": [leg(1, miles=0)], "crew": []})
    with pytest.raises(BrokenRule):
        voyages.save({"id": 5, "name": "x", "legs": [], "crew": [77]})
    with pytest.raises(BrokenRule):
        voyages.save({"id": 5, "name": None, "legs": [], "crew": []})
    voyages.save({"id": 5, "name": "x", "legs": [], "crew": [1]})
    with pytest.raises(BrokenRule, match="refers to"), voyages.store.transaction() as t:
        t.delete("sailor", rows_of(t, "sailor", [{"id": 1}]))
    with pytest.raises(AlreadyThere), voyages.store.transaction() as t:
        t.insert("sailor", rows_of(t, "sailor", [{"id": 8, "name": "n1"}]))
    assert voyages.store.table("sailor").count() == 3


def test_transactions(store, spark):
    t = derive(Object("note", (Field("id", ID, identity=True, computed=True), Field("text", TEXT, optional=True))))["note"]
    with store.transaction() as x:
        x.create(t)
    repo = Repository(store, Object("note", (Field("id", ID, identity=True, computed=True), Field("text", TEXT, optional=True))))
    assert repo.insert({"text": "first"})["id"] == 1 and repo.insert({"text": None})["id"] == 2
    with pytest.raises(ZeroDivisionError), store.transaction() as x:
        x.upsert("note", rows_of(x, "note", [{"id": 3, "text": "lost"}]))
        with store.transaction() as inner:
            assert inner is x and store.table("note").count() == 3
        1 / 0  # noqa: B018
    assert store.table("note").count() == 2
    other = Store(spark, store.root)
    with pytest.raises(Conflict), store.transaction() as x:
        x.upsert("note", rows_of(x, "note", [{"id": 4, "text": "mine"}]))
        transact(other, lambda y: y.upsert("note", rows_of(y, "note", [{"id": 5, "text": "theirs"}])))
    assert {r["id"] for r in store.table("note").collect()} == {1, 2, 5}
    for i in range(12):  # layers are compacted, rows stay
        transact(store, lambda y, i=i: y.upsert("note", rows_of(y, "note", [{"id": 1, "text": f"v{i}"}])))
    assert len(Snapshot.read(store.root).tables["note"]["layers"]) <= 9
    assert {r["id"]: r["text"] for r in store.table("note").collect()}[1] == "v11"


def test_statements(store, spark):
    t = derive(SAILOR)["sailor"]
    with store.transaction() as x:
        x.create(t)
    s = t.source()
    assert execute(store, InsertQuery("sailor", ["id", "name"], [(1, "a"), (2, "b"), (3, "c")])) == 3
    assert execute(store, UpsertQuery("sailor", ["id", "name"], [(3, "cc"), (4, "d")], ["id"])) == 2
    assert execute(store, UpsertQuery("sailor", ["id"], [(3,), (1,)], ["id"])) == 0
    assert execute(store, UpdateQuery(s, ["name"], [fn.concat(s.of("name"), "!")], cr.at_most(s.of("id"), 2))) == 2
    assert execute(store, DeleteQuery(s, cr.equal(s.of("id"), 4))) == 1 and execute(store, DeleteQuery(s, cr.equal(s.of("id"), 4))) == 0
    assert sorted(map(tuple, store.table("sailor").collect())) == [(1, "a!"), (2, "b!"), (3, "cc")]
    for wrong in (InsertQuery("sailor", ["id", "name"], [(1,)]), UpdateQuery(s, ["name", "id"], ["x"]), UpsertQuery("sailor", ["name"], [("x",)], ["id"]), InsertQuery("sailor", [], []), DeleteQuery(s, cr.equal(s.of("nope"), 1))):
        with pytest.raises(Refusal):
            execute(store, wrong)
    with pytest.raises(AlreadyThere):
        execute(store, InsertQuery("sailor", ["id", "name"], [(1, "x")]))
    e = Engine(spark, store)
    assert e.query_row(compose("SELECT count(*) AS n FROM ", table("sailor"), " WHERE id > ", bind(1), " AND name < ", bind("z")))["n"] == 2
    with pytest.raises(Refusal):
        e.query(compose("SELECT ", bind(object())))
    assert store.table("sailor").alias("sailor").filter(e.column(s, cr.like(s.of("name"), "%!"))).count() == 2
    assert compose("b").with_prefix("a").text == "ab"


def test_whole_aggregates_in_a_page(voyages, spark):
    voyages.bulk([{"id": i, "name": f"l{i}", "legs": [leg(k) for k in range(i)], "crew": [1]} for i in range(1, 6)])
    lst = voyages.listing().page_size(2).sort("name", voyages.source().of("name").desc())
    e = Engine(spark, voyages.store)
    page = voyages.page(e, lst)
    assert [(v["id"], len(v["legs"]), v["crew"]) for v in page.items] == [(5, 5, [1]), (4, 4, [1])]
    assert [v["id"] for v in voyages.page(e, lst, PageQuery(after=page.next)).items] == [3, 2]


def test_nested_rows_in_bulk(voyages, spark):
    values = [{"id": i, "name": f"l{i}", "berth": {"city": "c", "zip": None} if i % 2 else None, "legs": [leg(k) for k in range(i)][::-1], "vessel": {"id": i, "sign": "x"} if i % 3 == 0 else None, "crew": [3, 1][: i % 3]} for i in range(1, 8)]
    legs, place = "array<struct<id:long,harbour:string,miles:int>>", "struct<city:string,zip:string>"
    nested = spark.createDataFrame(values, f"id long, name string, berth {place}, legs {legs}, vessel struct<id:long,sign:string>, crew array<long>")
    assert voyages.load(nested) == 7
    for v in values:
        assert voyages.find(v["id"]) == v
    got = sorted((r.asDict(recursive=True) for r in voyages.nested().collect()), key=lambda v: v["id"])
    assert got == values
    assert voyages.save(values[3]) == 0


def test_represented_fields(store):
    o = Object("shelf", (Field("id", ID, identity=True), Field("crew", TEXT, optional=True)))
    repo = Repository(store, o, represent={"shelf.crew": (",".join, lambda t: t.split(","))})
    repo.create()
    assert repo.save({"id": 1, "crew": ["a", "b"]}) == 1 and repo.save({"id": 1, "crew": ["a", "b"]}) == 0
    assert repo.find(1) == {"id": 1, "crew": ["a", "b"]} and store.table("shelf").first()["crew"] == "a,b"


def test_index_layout(spark):
    df = Index(("k",)).clustered(spark.range(100).withColumn("k", F.col("id") % 10), 4)
    assert df.rdd.getNumPartitions() <= 4
    with pytest.raises(Refusal):
        Index(("k",), unique=True, include=("id",)).clustered(df, 2)


def test_stored_search(spark, tmp_path):
    s = [declare_search("name", ["name"], Match.PREFIX), declare_search("all", ["name", "more"], Match.WORDS)]
    df = searchable(spark.createDataFrame([(1, "Alien", "one two"), (2, "Other", "TWO alien")], "id long, name string, more string"), s)
    df.write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    some = df.filter(matches_stored(s[0], "ALI"))
    assert [r["id"] for r in some.collect()] == [1] and "StringStartsWith(name_search,ali)" in some._jdf.queryExecution().toString()
    assert df.filter(matches_stored(s[1], "two, Alien")).count() == 2 and unsearchable(df, s).columns == ["id", "name", "more"]


def test_collection(store, spark):
    stamp, album_ = (derive(Object(n, (Field("id", ID, identity=True),)))[n] for n in ("stamp", "album"))
    c = Collection(store, album_, "stamps", stamp)
    with store.transaction() as t:
        t.create(stamp, spark.range(1, 30).toDF("id"))
        t.create(album_, spark.range(1, 3).toDF("id"))
    c.create()
    for f in (1, 3, 4):
        c.insert(1, f)
    c.insert(1, 5, FIRST)
    c.insert(1, 6, after(4))
    c.move(1, 1, LAST)
    c.move(1, 5, before(3))
    e = Engine(spark, store)
    assert [r["stamp_id"] for r in c.listing(1).page(e, PageQuery(sort="placed")).items] == [5, 3, 4, 6, 1]
    assert c.remove(1, 5) == 1 and not c.has(1, 5) and c.has(1, 3)
    for wrong in (lambda: c.move(1, 99, FIRST), lambda: c.insert(1, 7, after(99))):
        with pytest.raises(NotInCollection):
            wrong()
    with pytest.raises(AlreadyThere):
        c.insert(1, 3)
    assert [r["stamp_id"] for r in c.listing(1).page(e, PageQuery(sort="value", size=2)).items] == [1, 3]


START = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("reference", T.StringType(), False), T.StructField("stored", T.StringType(), True)])


def pallets(back=True):
    h = History.start("pallet", "1.0.0", START).then("1.1.0", Rename("stored", "site"), Addition("handling", "string", default="standard"))
    h = h.then("2.0.0", Removal("site"), Retype("id", "string"))
    return h.then("3.0.0", Recomputation(("reference",), (("series", "string"), ("number", "long")), lambda d: d.withColumn("series", F.split("reference", "-")[0]).withColumn("number", F.split("reference", "-")[1].cast("long")), (lambda d: d.withColumn("reference", F.concat_ws("-", "series", "number"))) if back else None))


def test_evolution(spark):
    h, df = pallets(), spark.createDataFrame([(7, "P-2", "Kiel")], START)
    new = migrate_rows(h, df, "1.0.0", "3.0.0")
    assert new.first().asDict() == {"id": "7", "handling": "standard", "series": "P", "number": 2}
    assert migrate_rows(h, new, "3.0.0", "1.0.0").first().asDict() == {"id": 7, "stored": None, "reference": "P-2"}
    assert migrate_value(h, Engine(spark, {}), {"id": 1, "reference": "A-9", "stored": None}, "1.0.0", "1.1.0")["handling"] == "standard"
    with pytest.raises(Irreversible):
        pallets(back=False).between("3.0.0", "2.0.0")
    with pytest.raises(Refusal, match="neither default nor computation"):
        History.start("a", "1", START).then("2", Addition("x", "long")).between("1", "2")
    with pytest.raises(Refusal):
        h.between("1.0.0", "9")
    assert h.validate(h.latest().schema) is None and "doesn't have" in h.validate(T.StructType([*h.latest().schema.fields, T.StructField("x", T.LongType())]))


def test_migration(store, spark):
    h = pallets()
    table = derive(Object("pallet", (Field("id", ID, identity=True), Field("reference", TEXT), Field("stored", TEXT, optional=True))))["pallet"]
    assert migrate.apply(store, [migrate.Plan(h, table, "1.0.0")])[0].steps == ("1.0.0",)
    assert migrate.current(store, "pallet", "other_ledger") is None
    with store.transaction() as t:
        t.insert("pallet", rows_of(t, "pallet", [{"id": 1, "reference": "P-2", "stored": "Kiel"}]))
    seen = []
    plan = migrate.Plan(h, table, actions=(migrate.Action("2.0.0", lambda t: seen.append("up"), lambda t: seen.append("down")),))
    assert migrate.apply(store, [plan])[0].steps == ("1.1.0", "2.0.0", "3.0.0") and migrate.current(store, "pallet") == "3.0.0"
    assert store.table("pallet").first()["number"] == 2 and migrate.apply(store, [plan])[0].steps == ()
    assert migrate.apply(store, [migrate.Plan(h, table, "1.1.0", plan.actions)])[0].steps == ("2.0.0", "1.1.0") and seen == ["up", "down"]
    assert store.table("pallet").first()["reference"] == "P-2"


def test_rules_survive_migrations(store):
    """Keys, checks and defaults hold at every version that has their columns; child tables go with their root."""
    root = derive(Object("depot", (Field("id", ID, identity=True), Field("code", Scalar("text", (Rule("max_length", 4),)), unique=True), Field("bays", Sequence_(Object("bay", (Field("id", ID, identity=True), Field("tons", INT)))))), ))
    depot, bay = root["depot"], root["bay"]
    h = History.start("depot", "1", depot.schema()).then("2", Addition("note", "string", default="")).then("3", Rename("note", "remark"))
    child = migrate.Child(History.start("bay", "2", bay.schema()).then("3", Addition("closed", "boolean", default=False)), bay)
    plan = lambda v: [migrate.Plan(h, depot, v, children=(child,))]
    migrate.apply(store, plan("1"))
    assert store.names() == ["depot", "schema_version"]
    for v in ("2", "3"):
        migrate.apply(store, plan(v))
        assert store.known["depot"].unique == depot.unique and store.known["depot"].checks == depot.checks and store.known["bay"].foreign_keys == bay.foreign_keys
    assert store.table("bay").columns[-1] == "closed" and store.table("depot").columns[-1] == "remark"
    execute(store, InsertQuery("depot", ["id", "code", "remark"], [(1, "a", "")]))
    with pytest.raises(AlreadyThere):
        execute(store, InsertQuery("depot", ["id", "code", "remark"], [(2, "a", "")]))
    with pytest.raises(BrokenRule):
        execute(store, InsertQuery("depot", ["id", "code", "remark"], [(2, "too long", "")]))
    migrate.apply(store, plan("1"))
    assert store.names() == ["depot", "schema_version"] and store.table("depot").columns == ["id", "code"]
    with pytest.raises(Refusal, match="has versions that"):
        migrate.apply(store, [migrate.Plan(h, depot, children=(migrate.Child(History.start("bay", "9", bay.schema()), bay),))])


def test_a_cascade_over_a_cycle_ends(store):
    of = lambda name, column, other: Table(name, (("id", T.LongType(), False), (column, T.LongType(), True)), ("id",), foreign_keys=(ForeignKey((column,), other, ("id",), "cascade"),))
    node, left, right = of("node", "next", "node"), of("left_side", "of", "right_side"), of("right_side", "of", "left_side")
    with store.transaction() as t:
        for table_ in (node, left, right):
            t.create(table_)
        t.insert("node", rows_of(t, "node", [{"id": i, "next": (i + 1) % 4} for i in range(4)] + [{"id": 9, "next": 9}, {"id": 10, "next": None}]))
        t.insert("left_side", rows_of(t, "left_side", [{"id": 1, "of": 1}, {"id": 2, "of": None}]))
        t.insert("right_side", rows_of(t, "right_side", [{"id": 1, "of": 1}]))
    with store.transaction() as t:
        t.delete("node", rows_of(t, "node", [{"id": 2}, {"id": 9}]))
        t.delete("left_side", rows_of(t, "left_side", [{"id": 1}]))
    assert [r["id"] for r in store.table("node").collect()] == [10] and [r["id"] for r in store.table("left_side").collect()] == [2] and store.table("right_side").count() == 0


def test_small_writes_leave_the_first_layer_alone(store, spark):
    from sparkloom.sources.store import COMPACT

    note = Table("note", (("id", T.LongType(), False), ("text", T.StringType(), True)), ("id",))
    with store.transaction() as t:
        t.create(note, spark.range(500).selectExpr("id", "'first' AS text"))
    path = Snapshot.read(store.root).tables["note"]["layers"][0]["path"]
    for i in range(COMPACT + 3):
        with store.transaction() as t:
            t.upsert("note", rows_of(t, "note", [{"id": i, "text": f"new {i}"}]))
            t.delete("note", rows_of(t, "note", [{"id": 100 + i}]))
    layers = Snapshot.read(store.root).tables["note"]["layers"]
    assert layers[0]["path"] == path and len(layers) <= COMPACT
    got = {r["id"]: r["text"] for r in store.table("note").collect()}
    n = COMPACT + 3
    assert got == {i: f"new {i}" if i < n else "first" for i in range(500) if not 100 <= i < 100 + n}
    with store.transaction() as t:
        t.upsert("note", spark.range(400).selectExpr("id", "'all' AS text"))
    for i in range(COMPACT):
        transact(store, lambda t, i=i: t.upsert("note", rows_of(t, "note", [{"id": i, "text": "last"}])))
    assert Snapshot.read(store.root).tables["note"]["layers"][0]["path"] != path and store.table("note").count() == 500


def test_a_lock_ends_with_its_owner(tmp_path):
    import subprocess
    import sys

    code = f"import os; from sparkloom.sources.store import locked\nwith locked({str(tmp_path)!r}): os._exit(1)"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=False)
    with locked(str(tmp_path), 1.0), pytest.raises(Conflict), locked(str(tmp_path), 0.1):
        pass


def test_two_new_rows_of_one_key_are_refused(spark):
    old, new = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([(2, "x"), (2, "y")], "id long, text string")
    with pytest.raises(AlreadyThere):
        upserted(old, new, ["id"])


def test_what_a_layout_lacks_is_told(store, spark):
    repo = Repository(store, Object("crate", (Field("id", ID, identity=True), Field("name", TEXT), Field("parts", Sequence_(Object("part", (Field("id", ID, identity=True),)))))))
    assert repo.check() == ["crate is not there", "part is not there"]
    repo.create()
    assert repo.check() == []
    with Store(spark, store.root).transaction() as t:  # which knows no rules
        t.replace("crate", spark.range(1).selectExpr("id", "1 AS name"), Table("crate", (("id", T.LongType(), False), ("name", T.IntegerType(), True)), ("name",)))
        t.replace("part", spark.range(1))
    told = repo.check()
    assert "crate.name is int, not string" in told and "crate has the key (name), not (id)" in told and "part.crate_id is not there" in told


settings.register_profile("quick", deadline=None)
settings.load_profile("quick")
