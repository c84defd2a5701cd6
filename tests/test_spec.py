"""Specifications: kinds, refusals before Spark is asked, the algebra of criteria, keysets, cursors."""

import datetime as dt

import pytest

from sparkloom import functions as fn
from sparkloom.engine import Engine
from sparkloom.kinds import Kind, kind_of_value
from sparkloom.operators import criteria as cr
from sparkloom.operators import cursor
from sparkloom.operators.expr import Unsaid, Window, apply, column, param, refuse
from sparkloom.operators.listing import PageQuery, listing
from sparkloom.operators.operations import Registry, declare, flip, function, infix
from sparkloom.operators.search import Match, declare_search, matches, words_of
from sparkloom.plans.select import SelectQuery, from_, from_query, inner_join, select_columns, select_terms
from sparkloom.refusal import NoRows, PageCursorError, PageQueryError, Refusal, SeveralRows


class Unreachable:
    def __getattr__(self, name):
        raise AssertionError("Spark was asked")


T = from_("t", ("id", Kind.WHOLE), ("name", Kind.TEXT), ("score", Kind.NUMBER), ("at", Kind.MOMENT), ("ok", Kind.TRUTH))


def refused(**parts):
    with pytest.raises(Refusal) as e:
        Engine(Unreachable(), {}).compile(SelectQuery(**parts))
    return " ".join(e.value.reasons)


def test_kinds():
    assert Kind.UNKNOWN.admits(Kind.TEXT) and not Kind.WHOLE.admits(Kind.NUMBER)
    assert kind_of_value(True) is Kind.TRUTH and kind_of_value(1) is Kind.WHOLE and kind_of_value(dt.datetime.now()) is Kind.MOMENT
    assert kind_of_value(object()) is None and kind_of_value(None) is Kind.UNKNOWN


def test_refusals_name_every_reason():
    assert "selects nothing" in refused(source=T) and "no source" in refused(select=[param(1).as_("x")])
    why = refused(select=[T.of("nope").as_("x"), T.of("id", Kind.TEXT).as_("y")], source=T, where=cr.equal(T.of("id"), "a"))
    assert "no column nope" in why and "id is whole" in why and "equal to of whole and text" in why
    assert "cannot be bound" in refused(select=[param(object()).as_("x")], source=T)
    assert "stop" in refused(select=[refuse("stop").as_("x")], source=T)
    assert "two sources" in refused(select=[T.of("id").as_("x")], source=T, joins=[inner_join(T, cr.every_row())])
    assert "two selections" in refused(select=[T.of("id").as_("x"), T.of("name").as_("x")], source=T)
    assert "not truth" in refused(select=[T.of("id").as_("x")], source=T, where=T.of("id"))
    inner = SelectQuery(select=[T.of("nope").as_("x")], source=T)
    assert "no column nope" in refused(select=[column("x").as_("x")], source=from_query(inner, "q"))
    assert "takes text" in refused(select=[fn.lower(T.of("id")).as_("x")], source=T)
    assert "takes moments" in refused(select=[fn.seconds(T.of("id"), T.of("at")).as_("x")], source=T)


def test_unknown_operation_is_refused_by_name(spark):
    e = Engine(spark, {"t": spark.range(1)})
    with pytest.raises(Refusal, match="spark has no answer for the operation teleport"):
        e.compile(SelectQuery(select=[apply(declare("teleport"), 1).as_("x")], source=from_("t")))
    with pytest.raises(Refusal, match="takes 2 terms"):
        e.compile(SelectQuery(select=[apply(declare("x", infix("+", lambda a, b: a + b)), 1).as_("x")], source=from_("t")))


def test_operations_are_compared_by_identity(spark):
    a, b = declare("same"), declare("same")
    r = Registry().also({a: function("abs", 1)})
    assert r.builder(a) and r.builder(b) is None
    minus = declare("minus", flip(infix("-", lambda x, y: x - y)))
    assert Engine(spark, {"t": spark.range(1)}).row(SelectQuery(select=[apply(minus, 1, 10).as_("x")], source=from_("t")))["x"] == 9


def test_algebra_of_unsaid_criteria():
    a, none, every = cr.equal(T.of("id"), 1), cr.no_row(), cr.every_row()
    assert isinstance(cr.and_(), Unsaid) and cr.and_(every, a) is a and isinstance(cr.and_(every, every), Unsaid)
    assert cr.or_().identity() == none.identity() and isinstance(cr.or_(a, every), Unsaid) and cr.or_(a) is a
    assert cr.not_(every).identity() == none.identity() and cr.in_values(T.of("id"), []).identity() == none.identity()


@pytest.fixture(scope="module")
def reviewed(spark):
    rows = [(1, 3), (2, None), (3, 5), (4, None), (5, 3), (6, 1), (7, None)]
    return Engine(spark, {"reviewed": spark.createDataFrame(rows, "id long, rating long")})


R = from_("reviewed", ("id", Kind.WHOLE), ("rating", Kind.WHOLE))
L = listing(R, "id").page_size(3).max_page(10).sort("best", R.of("rating").desc().nulls_last()).sort("unrated", R.of("rating").desc().nulls_first())
BEST, UNRATED = [3, 5, 1, 6, 7, 4, 2], [7, 4, 2, 3, 5, 1, 6]


@pytest.mark.parametrize(("sort", "expected"), [("best", BEST), ("unrated", UNRATED)])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 10])
def test_walk_forward_and_back(reviewed, sort, expected, size):
    seen, at, pages = [], None, 0
    while True:
        page = L.page(reviewed, PageQuery(sort=sort, size=size, after=at))
        seen += [r["id"] for r in page.items]
        pages += 1
        last, at = page, page.next
        if not at:
            break
    assert seen == expected and pages == -(-7 // size)
    back, at = [r["id"] for r in last.items], last.previous
    while at:
        page = L.page(reviewed, PageQuery(sort=sort, size=size, before=at))
        back = [r["id"] for r in page.items] + back
        assert page.next
        at = page.previous
    assert back == expected


def test_numbered_pages_and_counts(reviewed):
    page = L.page(reviewed, PageQuery(size=2, number=2))
    assert [r["id"] for r in page.items] == BEST[2:4] and page.next and page.previous and page.number == 2
    assert L.page(reviewed, PageQuery(size=2, number=9)).items == []
    assert L.count(reviewed) == 7 and L.count_up_to(reviewed, 4) == 4 and L.count(reviewed, cr.is_null(R.of("rating"))) == 3
    keys = reviewed.compile(L.keys_first(PageQuery(size=2, number=2))).collect()
    assert [r["id"] for r in keys][:2] == BEST[2:4]


def test_page_refusals(reviewed):
    for q in (PageQuery(sort="odd"), PageQuery(size=11), PageQuery(after="x", number=2), PageQuery(size=-1)):
        with pytest.raises(PageQueryError):
            L.page(reviewed, q)
    other = L.cursor_at([3, 1], PageQuery(sort="unrated"))
    for bad in ("!!", other, other[:-2]):
        with pytest.raises(PageCursorError):
            L.page(reviewed, PageQuery(sort="best", after=bad))
    with pytest.raises(PageCursorError):  # another filter
        L.page(reviewed, PageQuery(where=cr.equal(R.of("id"), 1), after=L.cursor_at([3, 1])))
    unstated = listing(R, "id").sort("s", R.of("rating").asc())
    with pytest.raises(Refusal, match="doesn't say where nulls stand"):
        unstated.page(reviewed, PageQuery(after=unstated.cursor_at([None, 2])))
    with pytest.raises(Refusal):
        listing(R)


def test_index_columns():
    scoped = listing(R, "id").within(cr.and_(cr.equal(R.of("rating"), 3), cr.above(R.of("id"), 1))).sort("s", R.of("id").desc())
    assert scoped.indexes() == [("rating", "id")] and scoped.indexed_by("id").indexes()[0] == ("id",)


def test_cursor_values():
    values = [None, True, 7, 2.5, "ä|,", b"\x00\xff", dt.datetime(2024, 2, 3, 4, 5, 6, 7)]
    assert cursor.decode(cursor.encode("t", values), "t", len(values)) == values
    with pytest.raises(PageCursorError):
        cursor.decode(cursor.encode("t", values), "u", len(values))


def test_one_row(spark, reviewed):
    q = lambda n: SelectQuery(select=[R.of("id").as_("id")], source=R, where=cr.at_most(R.of("id"), n))
    assert reviewed.row(q(1))["id"] == 1
    with pytest.raises(NoRows):
        reviewed.row(q(0))
    with pytest.raises(SeveralRows):
        reviewed.row(q(2))
    assert next(iter(reviewed.rows(q(5))))["id"] == 1
    assert reviewed.query_row("SELECT ? + ? AS x", 1, 2)["x"] == 3


def test_unqualified_columns(reviewed):
    q = SelectQuery(select=[*select_columns("id"), *select_terms(R.of("rating"))], source=from_("reviewed"), where=cr.column_equals("id", 3))
    assert tuple(reviewed.row(q)) == (3, 5)


def test_aggregates_and_windows(reviewed):
    rank = fn.count().over(Window(order_by=[fn.coalesce(R.of("rating"), 0).desc()]))
    rows = reviewed.compile(SelectQuery(select=[R.of("id").as_("id"), rank.as_("n")], source=R)).collect()
    assert {r["id"]: r["n"] for r in rows} == {3: 1, 1: 3, 5: 3, 6: 4, 2: 7, 4: 7, 7: 7}
    with pytest.raises(Refusal, match="neither grouped"):
        reviewed.compile(SelectQuery(select=[R.of("id").as_("id"), fn.count().as_("n")], source=R))
    empty = reviewed.row(SelectQuery(select=[fn.count().as_("n"), fn.string_agg(column("x", Kind.TEXT), ",").as_("s")], source=from_query(SelectQuery(select=[param("a").as_("x")], source=R, where=cr.no_row()), "e")))
    assert empty["n"] == 0 and empty["s"] is None


def test_search(spark):
    films = [(1, "Alien", "A crew meets an alien."), (3, "Planet Aliens", "planet, alien; twice"), (4, "ALIEN³", "on the prison planet"), (5, "Arrival", "The alien planet?")]
    e = Engine(spark, {"film": spark.createDataFrame(films, "id long, name string, overview string")})
    f = from_("film", ("id", Kind.WHOLE), ("name", Kind.TEXT), ("overview", Kind.TEXT))
    s = [declare_search("prefix", ["name"], Match.PREFIX), declare_search("words", ["name", "overview"], Match.WORDS), declare_search("part", ["name"], Match.FRAGMENT), declare_search("stem", ["name"], Match.WORDS, "english"), declare_search("two", ["name", "overview"], Match.PREFIX)]
    ids = lambda name, text: sorted(r["id"] for r in e.rows(SelectQuery(select=[f.of("id").as_("id")], source=f, where=matches(f, s, name, text))))
    assert ids("prefix", "ali") == [1, 4] and ids("words", "Planet, ALIEN!") == [3, 4, 5] and ids("part", "LIE") == [1, 3, 4]
    assert ids("words", " ,! ") == [1, 3, 4, 5] and ids("prefix", "") == [1, 3, 4, 5] and ids("part", "%") == []
    for name in ("odd", "stem", "two"):
        with pytest.raises(Refusal):
            ids(name, "x")
    assert words_of("Élan_vital 3x") == ("élan", "vital", "3x")
