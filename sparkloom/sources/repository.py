"""Repositories: whole aggregates, stored across tables as the difference to what is there.

An aggregate is a nested Python value; its tables come from ``derive``. Saving reads the aggregate's rows (one query per
table), compares, and writes at most one layer of changed rows and one of gone keys per table; saving what is there
already writes nothing. Reading many aggregates is one semi-join per table, whatever their number.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.engine import Engine
from sparkloom.operators.expr import Expr
from sparkloom.operators.listing import Listing, Page, PageQuery
from sparkloom.operators.positions import GAP, placed
from sparkloom.plans.compile import quoted
from sparkloom.plans.select import SelectQuery
from sparkloom.refusal import NoRows, Refusal, SeveralRows
from sparkloom.sources.mapping import Naming
from sparkloom.sources.store import Store, Transaction, rows_of, transact
from sparkloom.sources.tables import POSITION, Field, Object, Reference, Sequence_, Table, derive

Rows = dict[str, dict[tuple, dict]]


def canonical(v: object) -> object:
    """Values that storage tells not apart are one: truth and 0 or 1, whole floats and wholes, texts and their bytes, instants of one moment."""
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "surrogateescape")
    if isinstance(v, dt.datetime):
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
    if isinstance(v, Mapping):
        return {k: canonical(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [canonical(x) for x in v]
    return v


class Repository:
    def __init__(self, store: Store, root: Object, *others: Object, naming: Naming | None = None, represent: Mapping[str, tuple[Callable, Callable]] | None = None):
        """``others``: objects that the root refers to. ``represent``: by ``object.field``, how values are stored and read back."""
        self.represent = dict(represent or {})
        self.store, self.root, self.naming = store, root, naming or Naming()
        tables = derive(root, *others, naming=self.naming)
        own = {self.naming.of(root.name)}
        for name, t in tables.items():
            if t.parent in own:
                own.add(name)
        self.layout: dict[str, Table] = {n: tables[n] for n in tables if n in own}
        self.tables = tables
        self.name = self.naming.of(root.name)
        self.key = self.layout[self.name].key
        store.describes(*tables.values())

    # layout

    def create(self) -> None:
        with self.store.transaction() as t:
            for table in self.tables.values():
                if table.name not in t.snapshot.tables:
                    t.create(table)

    def children(self, name: str) -> list[Table]:
        return [t for t in self.layout.values() if t.parent == name]

    def source(self):
        return self.layout[self.name].source()

    def _field(self, o: Object, path: str) -> Field:
        for part in path.split("."):
            f = next(x for x in o.fields if x.name == part)
            o = f.type if isinstance(f.type, Object) else o
        return f

    # values and rows

    def take_apart(self, value: Mapping) -> Rows:
        out: Rows = {n: {} for n in self.layout}
        self._rows(self.root, self.layout[self.name], value, {}, out, None)
        return out

    def _rows(self, o: Object, table: Table, value: Mapping, up: dict, out: Rows, place: int | None) -> None:
        row = dict(up)
        if place is not None:
            row[POSITION] = place
        below = []

        def add(f: Field, path: str, v: object) -> None:
            if isinstance(f.type, Sequence_) or (isinstance(f.type, Object) and f.type.identity()):
                below.append((f, path, v))
            elif isinstance(f.type, Object) and path not in o.documents:
                for m in f.type.fields:
                    add(m, f"{path}.{m.name}", None if v is None else v.get(m.name))
            else:
                stored = self.represent.get(f"{o.name}.{path}")
                row[self.naming.of(path)] = stored[0](v) if stored and v is not None else v

        for f in o.fields:
            add(f, f.name, value.get(f.name))
        key = tuple(row.get(k) for k in table.key)
        if any(k is None for k in key):
            missing = [k for k, v in zip(table.key, key, strict=True) if v is None]
            if below and any(v for _, _, v in below):
                raise Refusal(f"{table.name}'s {', '.join(missing)} is made by the store, so it cannot have children yet")
            if not set(missing) <= set(table.computed):
                raise Refusal(f"{table.name} lacks its {', '.join(missing)}")
        if key in out[table.name]:
            raise Refusal(f"{table.name} has {key} twice")
        out[table.name][key] = row
        for f, path, v in below:
            child = next(t for t in self.children(table.name) if t.field == path)
            links = next(k for k in child.foreign_keys if k.table == table.name)
            own = {c: row.get(k) for c, k in zip(links.columns, links.keys, strict=True)}
            target = f.type.of if isinstance(f.type, Sequence_) else f.type
            for i, x in enumerate((v or []) if isinstance(f.type, Sequence_) else ([] if v is None else [v])):
                if isinstance(target, Reference):
                    other = [c for c in child.key if c not in own]
                    linked = own | {other[0]: x, POSITION: i}
                    k = tuple(linked[c] for c in child.key)
                    if k in out[child.name]:
                        raise Refusal(f"{child.name} has {k} twice")
                    out[child.name][k] = linked
                else:
                    self._rows(target, child, x, own, out, None if child.single else i)

    def assemble(self, rows: Rows) -> list[dict]:
        return [self._value(self.root, self.layout[self.name], r, self._beneath(rows)) for r in rows[self.name].values()]

    def _beneath(self, rows: Rows) -> dict[str, dict[tuple, list[dict]]]:
        out = {}
        for name, own in rows.items():
            table = self.layout[name]
            if table.parent is None:
                continue
            links = next(k for k in table.foreign_keys if k.table == table.parent)
            groups = defaultdict(list)
            for r in own.values():
                groups[tuple(r[c] for c in links.columns)].append(r)
            for g in groups.values():
                g.sort(key=lambda r: r.get(POSITION) or 0)
            out[name] = groups
        return out

    def _value(self, o: Object, table: Table, row: dict, beneath: dict) -> dict:
        key = tuple(row[k] for k in table.key)

        def build(f: Field, path: str):
            if isinstance(f.type, Sequence_) or (isinstance(f.type, Object) and f.type.identity()):
                child = next(t for t in self.children(table.name) if t.field == path)
                found = beneath.get(child.name, {}).get(key, [])
                target = f.type.of if isinstance(f.type, Sequence_) else f.type
                if isinstance(target, Reference):
                    links = next(k for k in child.foreign_keys if k.table == table.name)
                    other = next(c for c in child.key if c not in links.columns)
                    return [r[other] for r in found]
                made = [self._value(target, child, r, beneath) for r in found]
                return made if isinstance(f.type, Sequence_) else (made[0] if made else None)
            if isinstance(f.type, Object) and path not in o.documents:
                made = {m.name: build(m, f"{path}.{m.name}") for m in f.type.fields}
                return None if f.optional and all(v is None for v in made.values()) else made
            v, stored = row.get(self.naming.of(path)), self.represent.get(f"{o.name}.{path}")
            return stored[1](v) if stored and v is not None else v

        return {f.name: build(f, f.name) for f in o.fields}

    # reading

    def frames(self, roots: DataFrame, read=None) -> dict[str, DataFrame]:
        """Rows of each table that belong to the given roots: one plan per table."""
        read = read or self.store.table
        out = {self.name: roots}
        for name, table in self.layout.items():
            if table.parent is not None:
                links = next(k for k in table.foreign_keys if k.table == table.parent)
                up = out[table.parent].select(*[F.col(quoted(k)).alias(c) for c, k in zip(links.columns, links.keys, strict=True)]).distinct()
                out[name] = read(name).join(up, list(links.columns), "left_semi")
        return out

    def _read(self, roots: DataFrame, read=None) -> Rows:
        out = {}
        for name, df in self.frames(roots, read).items():
            key = self.layout[name].key
            out[name] = {tuple(r[k] for k in key): r.asDict(recursive=True) for r in df.collect()}
        return out

    def _is(self, df: DataFrame, identity: object) -> DataFrame:
        given = identity if isinstance(identity, Mapping) else dict(zip(self.key, identity if isinstance(identity, tuple) else (identity,), strict=False))
        if set(given) != set(self.key):
            raise Refusal(f"{self.name} is identified by ({', '.join(self.key)}), not ({', '.join(given)})")
        for k, v in given.items():
            df = df.filter(F.col(quoted(k)) == F.lit(v))
        return df

    def find(self, identity: object) -> dict:
        found = self.assemble(self._read(self._is(self.store.table(self.name), identity)))
        if not found:
            raise NoRows(f"there is no {self.name} {identity}")
        return found[0]

    def find_by(self, where, limit: int = 0) -> list[dict]:
        """Aggregates whose root meets a criterion over ``source()``, or a Column."""
        df = self.store.table(self.name)
        if isinstance(where, Expr):
            s = self.source()
            df = Engine(self.store.spark, self.store).compile(SelectQuery(select=s.all(), source=s, where=where, order_by=[s.of(k).asc() for k in self.key], limit=limit))
        else:
            df = df.filter(where).orderBy(*map(quoted, self.key))
            df = df.limit(limit) if limit else df
        return sorted(self.assemble(self._read(df)), key=lambda v: tuple(str(v.get(f.name)) for f in self.root.identity()))

    def find_one_by(self, where) -> dict:
        found = self.find_by(where, 2)
        if not found:
            raise NoRows(f"no {self.name} is like that")
        if len(found) > 1:
            raise SeveralRows(f"several {self.name} are like that")
        return found[0]

    def listing(self) -> Listing:
        """A listing of roots; ``page`` reads the aggregates of one of its pages."""
        return Listing(self.source(), self.key)

    def page(self, engine: Engine, lst: Listing, q: PageQuery | None = None) -> Page:
        """Whole aggregates of a page: beside the page itself, one plan per child table."""
        page = lst.page(engine, q)
        if not page.items:
            return page
        roots = self.store.spark.createDataFrame([tuple(r) for r in page.items], self.store.table(self.name).schema)
        found = {tuple(v[f.name] for f in self.root.identity()): v for v in self.assemble(self._read(roots))}
        return replace(page, items=[found[tuple(r[k] for k in self.key)] for r in page.items])

    # writing

    def changes(self, before: Rows, after: Rows) -> dict[str, tuple[list[dict], list[tuple]]]:
        """Per table: rows to write and keys that go. Stored positions are kept where the order allows."""
        out = {}
        for name, table in self.layout.items():
            old, new = before.get(name, {}), after.get(name, {})
            if any(POSITION in r for r in new.values()):
                links = next(k for k in table.foreign_keys if k.table == table.parent)
                lists = defaultdict(list)
                for k, r in new.items():
                    lists[tuple(r[c] for c in links.columns)].append((r[POSITION], k))
                for own in lists.values():
                    own.sort()
                    for (_, k), p in zip(own, placed([old[k][POSITION] if k in old else None for _, k in own]), strict=True):
                        new[k] = {**new[k], POSITION: p}
            write = [r for k, r in new.items() if k not in old or any(canonical(old[k].get(c)) != canonical(v) for c, v in r.items())]
            out[name] = write, [k for k in old if k not in new]
        return out

    def _apply(self, t: Transaction, changes: dict[str, tuple[list[dict], list[tuple]]]) -> int:
        """Deletions from below, then writes from above. The number of layers written."""
        n = 0
        for name in reversed(list(self.layout)):
            gone = changes[name][1]
            if gone:
                t.delete(name, rows_of(t, name, [dict(zip(self.layout[name].key, k, strict=True)) for k in gone]))
                n += 1
        for name in self.layout:
            rows = changes[name][0]
            if rows:
                t.upsert(name, rows_of(t, name, rows))
                n += 1
        return n

    def save(self, value: Mapping) -> int:
        """The aggregate as it is now; returns the number of writes, 0 if nothing differs."""
        after = self.take_apart(value)
        root = next(iter(after[self.name].values()))

        def work(t: Transaction) -> int:
            before = self._read(self._is(t.table(self.name), {k: root[k] for k in self.key}), t.table)
            return self._apply(t, self.changes(before, after))

        return transact(self.store, work)

    def save_root(self, value: Mapping) -> int:
        """The root's own row alone; what is beneath stays."""
        row = next(iter(self.take_apart(value)[self.name].values()))
        return transact(self.store, lambda t: t.upsert(self.name, rows_of(t, self.name, [row])))

    def save_changes(self, before: Mapping, after: Mapping) -> int:
        """What differs between two values; stored rows are read only for lists whose order changes."""
        old, new = self.take_apart(before), self.take_apart(after)

        def work(t: Transaction) -> int:
            for name, table in self.layout.items():
                if any(POSITION in r for r in (*old[name].values(), *new[name].values())) and list(old[name]) != list(new[name]):
                    root = next(iter(new[self.name].values()))
                    stored = self._read(self._is(t.table(self.name), {k: root[k] for k in self.key}), t.table)[name]
                    for k, r in old[name].items():
                        old[name][k] = {**r, POSITION: stored[k][POSITION]} if k in stored else r
                elif any(POSITION in r for r in new[name].values()):  # the order is as it was: positions are not touched
                    for rows in (old[name], new[name]):
                        for k in rows:
                            rows[k] = {c: v for c, v in rows[k].items() if c != POSITION}
            return self._apply(t, self.changes(old, new))

        return transact(self.store, work)

    def insert(self, value: Mapping) -> dict:
        """A new aggregate. A computed identity is the largest one and one more, taken inside the transaction."""
        after = self.take_apart(value)
        made = {}

        def work(t: Transaction) -> dict:
            table = self.layout[self.name]
            rows = list(after[self.name].values())
            for k in table.key:
                if k in table.computed and rows[0].get(k) is None:
                    made[k] = (t.table(self.name).agg(F.max(quoted(k))).first()[0] or 0) + 1
                    rows[0][k] = made[k]
            for name in self.layout:
                if own := list(after[name].values()):
                    t.insert(name, rows_of(t, name, [{c: v for c, v in r.items() if v is not None or c not in self.layout[name].computed} for r in own]))
            return {**value, **{f.name: made[self.naming.of(f.name)] for f in self.root.identity() if self.naming.of(f.name) in made}}

        return transact(self.store, work)

    def rows_of(self, nested: DataFrame) -> dict[str, DataFrame]:
        """Nested rows, a row an aggregate with the object's fields, as rows of every table: projections and explodes only."""
        out: dict[str, DataFrame] = {}

        def go(o: Object, table: Table, rows: DataFrame, up: list[str]) -> None:
            columns, below = [F.col(quoted(c)) for c in up], []

            def add(f: Field, path: str, c: Column) -> None:
                if isinstance(f.type, Sequence_) or (isinstance(f.type, Object) and f.type.identity()):
                    below.append((f, path, c))
                elif isinstance(f.type, Object) and path not in o.documents:
                    for m in f.type.fields:
                        add(m, f"{path}.{m.name}", c[m.name])
                else:
                    columns.append(c.alias(self.naming.of(path)))

            for f in o.fields:
                add(f, f.name, F.col("_value")[f.name])
            own = rows.select(*columns, *[c.alias(f"_below_{i}") for i, (_, _, c) in enumerate(below)])
            out[table.name] = own.select(*[F.col(quoted(n)) for n, _, _ in table.columns if n in own.columns])
            for i, (f, path, _) in enumerate(below):
                child = next(t for t in self.children(table.name) if t.field == path)
                links = next(k for k in child.foreign_keys if k.table == table.name)
                key = [F.col(quoted(k)).alias(c) for c, k in zip(links.columns, links.keys, strict=True)]
                target = f.type.of if isinstance(f.type, Sequence_) else f.type
                if not isinstance(f.type, Sequence_):
                    go(target, child, own.filter(F.col(f"_below_{i}").isNotNull()).select(*key, F.col(f"_below_{i}").alias("_value")), list(links.columns))
                    continue
                listed = own.select(*key, F.posexplode(f"_below_{i}").alias(POSITION, "_value")).withColumn(POSITION, F.col(POSITION) * GAP)
                if isinstance(target, Reference):
                    other = next(c for c in child.key if c not in links.columns)
                    out[child.name] = listed.select(*links.columns, F.col("_value").alias(other), POSITION)
                else:
                    go(target, child, listed, [*links.columns, POSITION])

        go(self.root, self.layout[self.name], nested.select(F.struct("*").alias("_value")), [])
        return out

    def load(self, nested: DataFrame) -> int:
        """Any number of new aggregates from nested rows: one distributed write per table. The number of roots."""

        def work(t: Transaction) -> int:
            rows = self.rows_of(nested)
            return [t.insert(name, rows[name]) for name in self.layout][0]

        return transact(self.store, work)

    def nested(self, roots: DataFrame | None = None) -> DataFrame:
        """All stored aggregates, or those of given roots, as nested rows: one aggregation and one join per child table."""
        frames = self.frames(self.store.table(self.name) if roots is None else roots)

        def build(o: Object, table: Table) -> DataFrame:
            df = frames[table.name]
            for child in self.children(table.name):
                f = self._field(o, child.field)
                target = f.type.of if isinstance(f.type, Sequence_) else f.type
                links = next(k for k in child.foreign_keys if k.table == table.name)
                if isinstance(target, Reference):
                    inner = frames[child.name].withColumn("_value", F.col(quoted(next(c for c in child.key if c not in links.columns))))
                else:
                    inner = build(target, child)
                place = F.col(POSITION) if not child.single else F.lit(0)
                lists = inner.groupBy(*[F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(links.columns)]).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("_value").alias("v")))).alias("_list"))
                values = F.transform("_list", lambda x: x["v"])
                lists = lists.select(*[f"_k{i}" for i in range(len(links.columns))], (values if isinstance(f.type, Sequence_) else values[0]).alias(f"_field_{child.field}"))
                on = [F.col(quoted(k)) == F.col(f"_k{i}") for i, k in enumerate(links.keys)]
                empty = F.array().cast(lists.schema[f"_field_{child.field}"].dataType) if isinstance(f.type, Sequence_) else F.lit(None)
                joined = df.join(lists, on, "left")
                df = joined.select(*[F.col(quoted(c)) for c in df.columns], F.coalesce(F.col(quoted(f"_field_{child.field}")), empty).alias(f"_field_{child.field}"))

            def value(f: Field, path: str) -> Column:
                if isinstance(f.type, Sequence_) or (isinstance(f.type, Object) and f.type.identity()):
                    return F.col(quoted(f"_field_{path}"))
                if isinstance(f.type, Object) and path not in o.documents:
                    made = F.struct(*[value(m, f"{path}.{m.name}").alias(m.name) for m in f.type.fields])
                    if not f.optional:
                        return made
                    absent = F.lit(True)
                    for m in f.type.fields:
                        absent = absent & value(m, f"{path}.{m.name}").isNull()
                    return F.when(~absent, made)
                return F.col(quoted(self.naming.of(path)))

            return df.withColumn("_value", F.struct(*[value(f, f.name).alias(f.name) for f in o.fields]))

        return build(self.root, self.layout[self.name]).select("_value.*")

    def delete(self, identity: object) -> int:
        """The root and all beneath it; the number of roots that went."""
        return transact(self.store, lambda t: t.delete(self.name, self._is(t.table(self.name), identity)))

    def check(self) -> list[str]:
        """What of the layout the store lacks: tables, columns, their types, keys."""
        out, names = [], self.store.names()
        for name, table in self.tables.items():
            if name not in names:
                out.append(f"{name} is not there")
                continue
            there = {f.name: f.dataType for f in self.store.table(name).schema.fields}
            for column, kind, _ in table.columns:
                if column not in there:
                    out.append(f"{name}.{column} is not there")
                elif there[column] != kind:
                    out.append(f"{name}.{column} is {there[column].simpleString()}, not {kind.simpleString()}")
            if tuple(key := self.store.key(name)) != table.key:
                out.append(f"{name} has the key ({', '.join(key)}), not ({', '.join(table.key)})")
        return out

    def bulk(self, values: Sequence[Mapping]) -> int:
        """Many new or changed aggregates, replaced whole: one write per table."""
        rows: Rows = {n: {} for n in self.layout}
        for v in values:
            for name, own in self.take_apart(v).items():
                rows[name] |= own

        def work(t: Transaction) -> int:
            keys = rows_of(t, self.name, [dict(zip(self.key, k, strict=True)) for k in rows[self.name]])
            before = self._read(t.table(self.name).join(keys, list(self.key), "left_semi"), t.table)
            return self._apply(t, self.changes(before, rows))

        return transact(self.store, work)
