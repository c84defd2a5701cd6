"""Writing statements run against the store; each returns the number of rows it wrote or removed."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.engine import Engine
from sparkloom.plans.compile import quoted
from sparkloom.plans.statement import DeleteQuery, InsertQuery, UpdateQuery, UpsertQuery
from sparkloom.refusal import Refusal
from sparkloom.sources.store import Store, Transaction, rows_of, transact
from sparkloom.sources.writes import _condition, deleted, updated

Write = InsertQuery | UpsertQuery | UpdateQuery | DeleteQuery


def execute(store: Store, statement: Write) -> int:
    """A refused statement is never run. Inside an open transaction it joins that."""
    if why := statement.reasons():
        raise Refusal(*why)
    return transact(store, lambda t: _run(store, t, statement))


def _run(store: Store, t: Transaction, s: Write) -> int:
    if isinstance(s, (InsertQuery, UpsertQuery)):
        rows = rows_of(t, s.table, [dict(zip(s.columns, r, strict=True)) for r in s.rows])
        return t.insert(s.table, rows) if isinstance(s, InsertQuery) else t.upsert(s.table, rows, list(s.key))
    engine, name = Engine(store.spark, store), s.source.name
    key = t.snapshot.tables.get(name, {}).get("key")
    df, holds = _condition(engine, s.source, s.where)
    hit = df.filter(holds)
    if isinstance(s, DeleteQuery):
        if key:
            return t.delete(name, hit.select(*map(quoted, key)))
        n = hit.count()
        if n:
            t.replace(name, deleted(engine, s.source, s.where))
        return n
    n = hit.count()
    if not n:
        return 0
    after = updated(engine, s.source, dict(zip(s.columns, s.values, strict=True)), s.where)
    if key and not set(key) & set(s.columns):
        # only the rows that change are written
        changed = hit.select(*map(quoted, key))
        t.upsert(name, after.join(changed, key, "left_semi").select(*[F.col(quoted(c)) for c in after.columns]))
    else:
        t.replace(name, after)
    return n
