"""Hand-written statements put together from pieces, and statements that write.

A composed statement is SQL text with ``?`` for bound values and ``{name}`` for tables of the engine. Writing statements are
values like queries: what is wrong with them is found before anything is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from sparkloom.kinds import kind_of_value
from sparkloom.operators.criteria import every_row
from sparkloom.operators.expr import Expr
from sparkloom.plans.select import Source


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Bind:
    value: object


@dataclass(frozen=True)
class Statement:
    text: str
    values: tuple = ()
    why: tuple[str, ...] = ()

    def reasons(self) -> list[str]:
        return list(self.why)

    def with_prefix(self, text: str) -> Statement:
        return Statement(text + self.text, self.values, self.why)


def text(t: str) -> Text:
    return Text(t)


def bind(v: object) -> Bind:
    return Bind(v)


def table(name: str) -> Text:
    return Text("{" + name + "}")


def compose(*parts: Text | Bind | Statement | str) -> Statement:
    """Pieces in order; values are bound, never written into the text."""
    out, values, why = [], [], []
    for p in parts:
        if isinstance(p, Statement):
            out.append(p.text)
            values += p.values
            why += p.why
        elif isinstance(p, Bind):
            if kind_of_value(p.value) is None:
                why.append(f"a value of type {type(p.value).__name__} cannot be bound")
            out.append("?")
            values.append(p.value)
        else:
            out.append(p.text if isinstance(p, Text) else str(p))
    return Statement("".join(out), tuple(values), tuple(why))


def _widths(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> list[str]:
    out = [] if columns else ["a write names no column"]
    out += [f"two columns are called {c}" for c in sorted({c for c in columns if list(columns).count(c) > 1})]
    out += [f"row {i} has {len(r)} values for {len(columns)} columns" for i, r in enumerate(rows) if len(r) != len(columns)]
    return out + [f"a value of type {type(v).__name__} cannot be bound" for r in rows for v in r if kind_of_value(v) is None and not isinstance(v, (Mapping, list))]


@dataclass(frozen=True, eq=False)
class InsertQuery:
    table: str
    columns: Sequence[str]
    rows: Sequence[Sequence[object]]

    def reasons(self) -> list[str]:
        return ([] if self.table else ["a write names no table"]) + _widths(self.columns, self.rows) + ([] if self.rows else ["an insert has no row"])


@dataclass(frozen=True, eq=False)
class UpsertQuery:
    table: str
    columns: Sequence[str]
    rows: Sequence[Sequence[object]]
    key: Sequence[str]

    def reasons(self) -> list[str]:
        missing = [k for k in self.key if k not in self.columns]
        own = [f"an upsert's key column {k} is not among its columns" for k in missing] + ([] if self.key else ["an upsert has no key"])
        return InsertQuery(self.table, self.columns, self.rows).reasons() + own


@dataclass(frozen=True, eq=False)
class UpdateQuery:
    source: Source
    columns: Sequence[str]
    values: Sequence[object]
    where: Expr = field(default_factory=every_row)

    def reasons(self) -> list[str]:
        plain = [v for v in self.values if not isinstance(v, Expr)]
        out = _widths(self.columns, [self.values] if len(self.columns) != len(self.values) else [])
        out += [f"a value of type {type(v).__name__} cannot be bound" for v in plain if kind_of_value(v) is None]
        return out + [r for v in self.values if isinstance(v, Expr) for r in v.reasons()] + self.where.reasons()


@dataclass(frozen=True, eq=False)
class DeleteQuery:
    source: Source
    where: Expr = field(default_factory=every_row)

    def reasons(self) -> list[str]:
        return self.source.reasons() + self.where.reasons()
