"""Expressions, selections, orderings and windows as values. Nothing here touches Spark.

An expression knows its kind and the reasons why it must be refused; ``identity`` tells equal expressions of one query.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from sparkloom.kinds import Kind, kind_of_value
from sparkloom.operators.operations import Operation


class Nulls(Enum):
    UNSTATED = 0
    FIRST = 1
    LAST = 2


class Expr:
    kind: Kind = Kind.UNKNOWN

    def children(self) -> tuple[Expr, ...]:
        return ()

    def reasons(self) -> list[str]:
        return [r for c in self.children() for r in c.reasons()]

    def identity(self) -> tuple:
        raise NotImplementedError

    @property
    def unsaid(self) -> bool:
        """A criterion that says nothing: it holds for every row, and clauses leave it out."""
        return False

    def as_(self, name: str) -> Selection:
        return Selection(self, name)

    def asc(self) -> Ordering:
        return Ordering(self, False)

    def desc(self) -> Ordering:
        return Ordering(self, True)

    def over(self, window: Window) -> Expr:
        return Over(self, window)


@dataclass(frozen=True, eq=False)
class Col(Expr):
    """A column, of a named source or unqualified."""

    name: str
    source: str | None = None
    kind: Kind = Kind.UNKNOWN

    def identity(self) -> tuple:
        return "col", self.source, self.name


@dataclass(frozen=True, eq=False)
class Val(Expr):
    """A bound value."""

    value: object
    kind: Kind = Kind.UNKNOWN

    def reasons(self) -> list[str]:
        return [f"a value of type {type(self.value).__name__} cannot be bound"] if kind_of_value(self.value) is None else []

    def identity(self) -> tuple:
        return "val", type(self.value).__name__, repr(self.value)


@dataclass(frozen=True, eq=False)
class Apply(Expr):
    op: Operation
    args: tuple[Expr, ...] = ()
    kind: Kind = Kind.UNKNOWN
    detail: object = None

    def children(self) -> tuple[Expr, ...]:
        return self.args

    def identity(self) -> tuple:
        return ("apply", id(self.op), repr(self.detail), *(a.identity() for a in self.args))


@dataclass(frozen=True, eq=False)
class Unsaid(Expr):
    """Every row."""

    kind: Kind = Kind.TRUTH

    @property
    def unsaid(self) -> bool:
        return True

    def identity(self) -> tuple:
        return ("unsaid",)


@dataclass(frozen=True, eq=False)
class Sub(Expr):
    """A query as a value (its one column of its one row), as a list for membership, or for existence."""

    query: object = None
    kind: Kind = Kind.UNKNOWN

    def reasons(self) -> list[str]:
        return self.query.reasons()

    def identity(self) -> tuple:
        return "sub", self.query.identity()


@dataclass(frozen=True, eq=False)
class Over(Expr):
    expr: Expr
    window: Window

    @property
    def kind(self) -> Kind:  # type: ignore[override]
        return self.expr.kind

    def children(self) -> tuple[Expr, ...]:
        return (self.expr, *self.window.partition_by, *(o.expr for o in self.window.order_by))

    def identity(self) -> tuple:
        return "over", self.expr.identity(), tuple(p.identity() for p in self.window.partition_by), tuple(o.identity() for o in self.window.order_by)


@dataclass(frozen=True, eq=False)
class Refused(Expr):
    why: tuple[str, ...] = ()

    def reasons(self) -> list[str]:
        return list(self.why)

    def identity(self) -> tuple:
        return "refused", self.why


@dataclass(frozen=True, eq=False)
class Selection:
    expr: Expr
    alias: str | None = None

    @property
    def name(self) -> str | None:
        return self.alias or getattr(self.expr, "name", None)

    @property
    def kind(self) -> Kind:
        return self.expr.kind


@dataclass(frozen=True, eq=False)
class Ordering:
    expr: Expr
    descending: bool = False
    nulls: Nulls = Nulls.UNSTATED

    def nulls_first(self) -> Ordering:
        return replace(self, nulls=Nulls.FIRST)

    def nulls_last(self) -> Ordering:
        return replace(self, nulls=Nulls.LAST)

    def reversed(self) -> Ordering:
        """The other way round, nulls at the other end."""
        other = {Nulls.FIRST: Nulls.LAST, Nulls.LAST: Nulls.FIRST, Nulls.UNSTATED: Nulls.UNSTATED}
        return Ordering(self.expr, not self.descending, other[self.nulls])

    def identity(self) -> tuple:
        return self.expr.identity(), self.descending, self.nulls.value


@dataclass(frozen=True, eq=False)
class Window:
    """Partition and order without a frame: the whole partition, or up to the row and its peers if ordered."""

    partition_by: tuple[Expr, ...] = field(default=())
    order_by: tuple[Ordering, ...] = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "partition_by", tuple(self.partition_by))
        object.__setattr__(self, "order_by", tuple(self.order_by))


def column(name: str, kind: Kind = Kind.UNKNOWN) -> Col:
    return Col(name, None, kind)


def param(value: object) -> Val:
    return Val(value, kind_of_value(value) or Kind.UNKNOWN)


def term(x: object) -> Expr:
    """An expression as it is, anything else as a bound value."""
    return x if isinstance(x, Expr) else param(x)


def apply(operation: Operation, *args: object, kind: Kind = Kind.UNKNOWN, detail: object = None) -> Apply:
    return Apply(operation, tuple(term(a) for a in args), kind, detail)


def same_kind(what: str, kind: Kind, *args: Expr) -> Expr | None:
    """A refusal if the terms' kinds do not admit each other."""
    kinds = [a.kind for a in args]
    for a, b in zip(kinds, kinds[1:], strict=False):
        if not a.admits(b):
            return Refused(tuple([f"{what} of {a.value} and {b.value}", *(r for x in args for r in x.reasons())]))
    return None


def subquery(query: object) -> Sub:
    selections = query.selections()
    return Sub(query, selections[0].kind if selections else Kind.UNKNOWN)


def refuse(*why: str) -> Refused:
    return Refused(why)


def aggregates_of(e: Expr) -> list[Apply]:
    """Aggregates outside windows; those under a window count if they are arguments of the windowed one."""
    if isinstance(e, Apply) and e.op.aggregate:
        return [e]
    if isinstance(e, Over):
        inner = [x for a in e.expr.children() for x in aggregates_of(a)]
        return inner + [x for c in e.children()[1:] for x in aggregates_of(c)]
    return [x for c in e.children() for x in aggregates_of(c)]


def queries_of(e: Expr) -> list[object]:
    """The queries inside an expression."""
    return [e.query] if isinstance(e, Sub) else [q for c in e.children() for q in queries_of(c)]
