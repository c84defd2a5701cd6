"""Declared listings: what may be paged, in which orders, and how far.

A page is one plan and one collect of at most ``size + 1`` rows: the one more tells whether there is a next page. Pages are
found by position (keyset), so a page deep in a listing costs as much as the first; numbered pages use an offset. The
listing's key is appended to every order, in the direction of its last term, so that every order is total.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sparkloom.engine import Engine
from sparkloom.functions import count
from sparkloom.operators import cursor
from sparkloom.operators import operations as op
from sparkloom.operators.criteria import after, and_, every_row
from sparkloom.operators.expr import Apply, Col, Expr, Ordering, Selection, Val
from sparkloom.plans.select import CTE, SelectQuery, Source, columns_equal, inner_join
from sparkloom.refusal import PageCursorError, PageQueryError, Refusal

DEFAULT_SIZE, LARGEST = 25, 100


@dataclass(frozen=True)
class PageQuery:
    sort: str | None = None
    size: int = 0
    after: str | None = None
    before: str | None = None
    number: int = 0
    where: Expr = field(default_factory=every_row)


@dataclass(frozen=True)
class Page:
    items: list[Row]
    next: str | None
    previous: str | None
    number: int = 0


@dataclass(frozen=True)
class _Plan:
    order: tuple[Ordering, ...]
    where: Expr
    size: int
    tag: str


@dataclass(frozen=True, eq=False)
class Listing:
    source: Source
    key: tuple[str, ...]
    sorts: tuple[tuple[str, tuple[Ordering, ...]], ...] = ()
    size: int = DEFAULT_SIZE
    largest: int = LARGEST
    scope: Expr = field(default_factory=every_row)
    ctes: tuple[CTE, ...] = ()
    indexed: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self):
        if not self.key:
            raise Refusal("a listing needs a key")

    def sort(self, name: str, *order: Ordering) -> Listing:
        """The first one declared is the default."""
        if any(not isinstance(o.expr, Col) for o in order):
            raise Refusal(f"the sort {name} is by something else than columns")
        return replace(self, sorts=(*self.sorts, (name, order)))

    def page_size(self, n: int) -> Listing:
        return replace(self, size=n)

    def max_page(self, n: int) -> Listing:
        return replace(self, largest=n)

    def within(self, scope: Expr) -> Listing:
        return replace(self, scope=and_(self.scope, scope))

    def using(self, *ctes: CTE) -> Listing:
        return replace(self, ctes=(*self.ctes, *ctes))

    def indexed_by(self, *columns: str) -> Listing:
        return replace(self, indexed=(*self.indexed, columns))

    # what a request means

    def plan(self, q: PageQuery) -> _Plan:
        if len([x for x in (q.after, q.before, q.number) if x]) > 1:
            raise PageQueryError("a page is after a position, before one, or numbered: one of these")
        if q.number < 0 or q.size < 0:
            raise PageQueryError("page numbers and sizes are not negative")
        size = q.size or min(self.size, self.largest)
        if size > self.largest:
            raise PageQueryError(f"a page holds {self.largest} items at most, not {size}")
        name, order = "", ()
        if self.sorts:
            name, order = self.sorts[0] if q.sort is None else next((s for s in self.sorts if s[0] == q.sort), (None, ()))
        if name is None or (q.sort is not None and not self.sorts):
            raise PageQueryError(f"there is no sort {q.sort}")
        descending = bool(order) and order[-1].descending
        named = {o.expr.name for o in order}
        order = (*order, *(Ordering(self.source.of(k), descending) for k in self.key if k not in named))
        where = and_(self.scope, q.where)
        return _Plan(order, where, size, f"{name}/{cursor.fingerprint((self.source.identity(), where.identity(), [o.identity() for o in order]))}")

    def query(self, q: PageQuery) -> tuple[SelectQuery, _Plan]:
        """The query of a page; that of a page before a position runs backwards."""
        p = self.plan(q)
        base = SelectQuery(select=self.source.all(), source=self.source, with_=self.ctes, where=p.where, limit=p.size + 1)
        if q.before:
            order = tuple(o.reversed() for o in p.order)
            return replace(base, order_by=order, after=after(order, cursor.decode(q.before, p.tag, len(order)))), p
        if q.number:
            return replace(base, order_by=p.order, offset=(q.number - 1) * p.size), p
        where = after(p.order, cursor.decode(q.after, p.tag, len(p.order))) if q.after else every_row()
        return replace(base, order_by=p.order, after=where), p

    def keys_first(self, q: PageQuery) -> SelectQuery:
        """A numbered page in two steps: keys alone are ordered and cut, rows are joined to them. It pays for wide rows."""
        base, p = self.query(q)
        names = dict.fromkeys([*self.key, *(o.expr.name for o in p.order)])
        keys = replace(base, select=[Selection(self.source.of(k), k) for k in names]).as_("page_keys")
        on = and_(*[columns_equal(self.source, k, keys, k) for k in self.key])
        order = [Ordering(keys.of(o.expr.name), o.descending, o.nulls) for o in p.order]
        return SelectQuery(select=self.source.all(), source=self.source, with_=self.ctes, joins=[inner_join(keys, on)], order_by=order)

    # reading

    def page(self, engine: Engine, q: PageQuery | None = None) -> Page:
        q = q or PageQuery()
        query, p = self.query(q)
        rows = engine.compile(query).collect()
        more, rows = len(rows) > p.size, rows[: p.size]
        if q.before:
            rows.reverse()
        at = lambda row: cursor.encode(p.tag, [row[o.expr.name] for o in p.order])
        if not rows:
            return Page([], None, None, q.number)
        if q.before:
            return Page(rows, at(rows[-1]), at(rows[0]) if more else None)
        earlier = bool(q.after) or q.number > 1
        return Page(rows, at(rows[-1]) if more else None, at(rows[0]) if earlier else None, q.number)

    def cursor_at(self, values: Sequence[object], q: PageQuery | None = None) -> str:
        p = self.plan(q or PageQuery())
        if len(values) != len(p.order):
            raise PageCursorError(f"a position of {len(values)} values where the order has {len(p.order)}")
        return cursor.encode(p.tag, values)

    def count(self, engine: Engine, where: Expr | None = None) -> int:
        q = SelectQuery(select=[Selection(count(), "n")], source=self.source, with_=self.ctes, where=and_(self.scope, where or every_row()))
        return engine.row(q)["n"]

    def count_up_to(self, engine: Engine, most: int, where: Expr | None = None) -> int:
        """No more than ``most`` rows are looked for."""
        q = SelectQuery(select=[Selection(self.source.of(k), k) for k in self.key], source=self.source, with_=self.ctes, where=and_(self.scope, where or every_row()), limit=most)
        return engine.compile(q).count()

    # layout

    def indexes(self) -> list[tuple[str, ...]]:
        """Columns by which the table would best be clustered: declared ones, and for each sort those of the scope's equalities, the sort and the key."""
        fixed = _equalities(self.scope)
        out = list(self.indexed)
        for _, order in self.sorts or (("", ()),):
            out.append(tuple(dict.fromkeys([*fixed, *(o.expr.name for o in order), *self.key])))
        return list(dict.fromkeys(out))

    def clustered(self, df: DataFrame, partitions: int, index: int = 0) -> DataFrame:
        """Rows dealt by ranges of an index and sorted in them, so that Parquet's statistics let pages skip files."""
        columns = [F.col(f"`{c}`") for c in self.indexes()[index]]
        return df.repartitionByRange(partitions, *columns).sortWithinPartitions(*columns)


def _equalities(e: Expr) -> list[str]:
    """Columns that a criterion holds to one value, through conjunctions and brackets."""
    if not isinstance(e, Apply):
        return []
    if e.op in (op.CONJUNCTION, op.BRACKET):
        return [c for a in e.args for c in _equalities(a)]
    if e.op is op.EQUAL_TO and isinstance(e.args[0], Col) and isinstance(e.args[1], Val):
        return [e.args[0].name]
    return []


def listing(source: Source, *key: str) -> Listing:
    return Listing(source, key)
