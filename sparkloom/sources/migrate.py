"""Migrations: tables of a store brought to a version of their history, one recorded step at a time.

A ledger table holds the version of each aggregate. A migration is one transaction under a lock of its own: it reads the
ledger, creates what isn't there or carries rows along the history, forward or back, and records every version it passes.
An aggregate's child tables have histories of their own, whose versions are some of the root's; they are carried with it.
Keys, references, checks and defaults of a plan's tables hold at every version that has their columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.refusal import Refusal
from sparkloom.sources.evolve import History, migrate_rows
from sparkloom.sources.store import Store, Transaction, locked, rows_of
from sparkloom.sources.tables import Table

LEDGER = "schema_version"
MIGRATION_LOCK = "_migration_lock"


@dataclass(frozen=True)
class Action:
    """Work of one's own on the way into a version, on the transaction, after its rows are carried."""

    version: str
    forward: Callable[[Transaction], None] | None = None
    back: Callable[[Transaction], None] | None = None


@dataclass(frozen=True)
class Child:
    """A child table: at a version that its history doesn't have it is as at the one before."""

    history: History
    table: Table

    def at(self, versions: Sequence[str]) -> str | None:
        """Its version when the root has passed ``versions``; None before its first."""
        own = [v for v in versions if v in self.history.versions()]
        return own[-1] if own else None


@dataclass(frozen=True)
class Plan:
    history: History
    table: Table
    target: str | None = None  # the latest, if not stated
    actions: tuple[Action, ...] = ()
    children: tuple[Child, ...] = ()


@dataclass(frozen=True)
class Report:
    aggregate: str
    before: str | None
    after: str
    steps: tuple[str, ...] = field(default=())


def ledger_table(name: str = LEDGER) -> Table:
    return Table(name, (("aggregate", T.StringType(), False), ("version", T.StringType(), False)), ("aggregate",))


def current(store: Store, aggregate: str, ledger: str = LEDGER) -> str | None:
    if ledger not in store.names():
        return None
    row = store.table(ledger).filter(F.col("aggregate") == F.lit(aggregate)).first()
    return row["version"] if row else None


def apply(store: Store, plans: Sequence[Plan], ledger: str = LEDGER) -> list[Report]:
    """All plans in one transaction; a failure leaves everything as it was. What is there already is left alone."""
    names = [p.history.name for p in plans]
    if len(set(names)) != len(names):
        raise Refusal("an aggregate is planned twice")
    for p in plans:
        p.history.place(p.target or p.history.latest().version)
        for c in p.children:
            if unknown := [v for v in c.history.versions() if v not in p.history.versions()]:
                raise Refusal(f"{c.history.name} has versions that {p.history.name} doesn't: {', '.join(unknown)}")
    table = ledger_table(ledger)
    store.describes(table)
    out = []
    with locked(store.root, name=MIGRATION_LOCK), store.transaction() as t:
        if ledger not in t.snapshot.tables:
            t.create(table)
        for p in plans:
            out.append(_one(store, t, p, ledger))
    return out


def ruled(table: Table, schema: T.StructType) -> Table:
    """The table with another schema, and those of its rules whose columns are there."""
    has = set(schema.names)
    if not set(table.key) <= has:
        raise Refusal(f"{table.name} has no {', '.join(k for k in table.key if k not in has)} to be known by")
    return replace(
        table,
        columns=tuple((f.name, f.dataType, f.nullable) for f in schema.fields),
        unique=tuple(u for u in table.unique if set(u) <= has),
        foreign_keys=tuple(k for k in table.foreign_keys if set(k.columns) <= has),
        checks=tuple(c for c in table.checks if c.column in has),
        defaults={k: v for k, v in table.defaults.items() if k in has},
    )


def _step(t: Transaction, history: History, table: Table, here: str | None, there: str | None) -> None:
    if there is None:
        t.drop(table.name)
    elif here is None:
        t.create(ruled(table, history.at(there).schema))
    elif here != there:
        df: DataFrame = migrate_rows(history, t.table(table.name), here, there)
        t.replace(table.name, df, ruled(table, history.at(there).schema))


def _one(store: Store, t: Transaction, plan: Plan, ledger: str) -> Report:
    h, target = plan.history, plan.target or plan.history.latest().version
    here, versions = current(store, h.name, ledger), h.versions()
    record = lambda v: t.upsert(ledger, rows_of(t, ledger, [{"aggregate": h.name, "version": v}]))
    if here is None:
        _step(t, h, plan.table, None, target)
        for c in plan.children:
            if (v := c.at(versions[: h.place(target) + 1])) is not None:
                _step(t, c.history, c.table, None, v)
        record(target)
        return Report(h.name, None, target, (target,))
    a, z = h.place(here), h.place(target)
    steps = []
    while a != z:
        b = a + 1 if a < z else a - 1
        _step(t, h, plan.table, versions[a], versions[b])
        for c in plan.children:
            old, new = c.at(versions[: a + 1]), c.at(versions[: b + 1])
            if old != new:
                _step(t, c.history, c.table, old, new)
        for action in plan.actions:
            if action.version == versions[max(a, b)]:
                work = action.forward if a < b else action.back
                if work:
                    work(t)
        record(versions[b])
        steps.append(versions[b])
        a = b
    return Report(h.name, here, target, tuple(steps))
