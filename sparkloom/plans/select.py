"""The query specification: a value of ten optional parts, checked before anything runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from sparkloom.kinds import Kind
from sparkloom.operators.criteria import and_, equal, every_row
from sparkloom.operators.expr import Col, Expr, Ordering, Refused, Selection, queries_of


@dataclass(frozen=True, eq=False)
class Source:
    """A table, a named query or a derived one. With declared columns, references are checked by name and kind."""

    name: str
    alias: str | None = None
    columns: tuple[tuple[str, Kind], ...] = ()
    query: SelectQuery | None = None
    named: bool = False  # of a CTE

    @property
    def label(self) -> str:
        return self.alias or self.name

    def as_(self, alias: str) -> Source:
        return replace(self, alias=alias)

    def of(self, name: str, kind: Kind = Kind.UNKNOWN) -> Expr:
        """A column of this source."""
        if not self.columns:
            return Col(name, self.label, kind)
        own = dict(self.columns)
        if name not in own:
            return Refused((f"{self.label} has no column {name}",))
        if not own[name].admits(kind):
            return Refused((f"{self.label}.{name} is {own[name].value}, not {kind.value}",))
        return Col(name, self.label, own[name] if own[name] is not Kind.UNKNOWN else kind)

    def all(self) -> tuple[Selection, ...]:
        """Every declared column, as selections."""
        return tuple(Selection(self.of(n)) for n, _ in self.columns)

    def reasons(self) -> list[str]:
        out = [] if self.name or self.query is not None else ["a source has no name"]
        if self.query is not None and not self.label:
            out.append("a derived query has no alias")
        return out + (self.query.reasons() if self.query is not None else [])

    def identity(self) -> tuple:
        return self.name, self.alias, self.query.identity() if self.query is not None and not self.named else None


def from_(table: str, *columns: tuple[str, Kind]) -> Source:
    return Source(table, columns=columns)


def from_query(query: SelectQuery, alias: str) -> Source:
    return Source("", alias, tuple((s.name, s.kind) for s in query.selections() if s.name), query)


@dataclass(frozen=True, eq=False)
class CTE:
    name: str
    query: SelectQuery

    def source(self) -> Source:
        return Source(self.name, None, tuple((s.name, s.kind) for s in self.query.selections() if s.name), self.query, True)


def with_(name: str, query: SelectQuery) -> CTE:
    return CTE(name, query)


@dataclass(frozen=True, eq=False)
class Join:
    source: Source
    on: Expr
    how: str


def select_columns(*names: str) -> list[Selection]:
    return [Selection(Col(n)) for n in names]


def select_terms(*terms: Expr) -> list[Selection]:
    return [Selection(t) for t in terms]


def inner_join(source: Source, on: Expr) -> Join:
    return Join(source, on, "inner")


def left_join(source: Source, on: Expr) -> Join:
    return Join(source, on, "left")


def columns_equal(left: Source, lc: str, right: Source, rc: str) -> Expr:
    return equal(left.of(lc), right.of(rc))


@dataclass(frozen=True, eq=False)
class SelectQuery:
    select: Sequence[Selection | Expr] = ()
    source: Source | None = None
    with_: Sequence[CTE] = ()
    joins: Sequence[Join] = ()
    where: Expr = field(default_factory=every_row)
    group_by: Sequence[Expr] = ()
    having: Expr = field(default_factory=every_row)
    order_by: Sequence[Ordering] = ()
    after: Expr = field(default_factory=every_row)
    limit: int = 0
    offset: int = 0

    def selections(self) -> list[Selection]:
        return [s if isinstance(s, Selection) else Selection(s) for s in self.select]

    def filter(self) -> Expr:
        return and_(self.where, self.after)

    def as_(self, alias: str) -> Source:
        return from_query(self, alias)

    def sources(self) -> list[Source]:
        return ([self.source] if self.source else []) + [j.source for j in self.joins]

    def expressions(self) -> list[Expr]:
        return [*(s.expr for s in self.selections()), *(j.on for j in self.joins), self.filter(), *self.group_by, self.having, *(o.expr for o in self.order_by)]

    def cuts(self) -> bool:
        """Whether a limit or an offset, its own or of a query inside, may leave other rows each time it runs."""
        inside = [*(c.query for c in self.with_), *(s.query for s in self.sources() if s.query is not None), *(q for e in self.expressions() for q in queries_of(e))]
        return bool(self.limit or self.offset) or any(q.cuts() for q in inside)

    def reasons(self) -> list[str]:
        """Everything that forbids this query, found before Spark is asked."""
        out = []
        if not self.select:
            out.append("the query selects nothing")
        if self.source is None:
            out.append("the query has no source")
        if self.limit < 0 or self.offset < 0:
            out.append("limit and offset cannot be negative")
        labels = [s.label for s in self.sources()]
        out += [f"two sources are called {x}" for x in sorted({x for x in labels if labels.count(x) > 1})]
        names = [s.name for s in self.selections()]
        out += [f"a selection of {type(s.expr).__name__} has no name" for s in self.selections() if s.name is None]
        out += [f"two selections are called {x}" for x in sorted({x for x in names if x and names.count(x) > 1})]
        for part in (*(c.query for c in self.with_), *self.sources(), *self.expressions()):
            out += part.reasons()
        for what, e in (("where", self.filter()), ("having", self.having), *(("a join", j.on) for j in self.joins)):
            if not e.kind.admits(Kind.TRUTH) and not isinstance(e, Refused):
                out.append(f"{what} is {e.kind.value}, not truth")
        return list(dict.fromkeys(out))

    def identity(self) -> tuple:
        return (
            tuple((s.name, s.expr.identity()) for s in self.selections()),
            tuple(s.identity() for s in self.sources()),
            tuple((c.name, c.query.identity()) for c in self.with_),
            tuple((j.how, j.on.identity()) for j in self.joins),
            self.filter().identity(),
            tuple(g.identity() for g in self.group_by),
            self.having.identity(),
            tuple(o.identity() for o in self.order_by),
            self.limit,
            self.offset,
        )
