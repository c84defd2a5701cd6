"""A store of tables as immutable Parquet layers under one manifest.

A table is a list of layers: each holds rows that replace those of the same key beneath it, or keys that are gone. A small
change writes a small layer and leaves the rest alone. Beyond ``COMPACT`` layers those above the first are merged, and the
table is written whole only once they hold half as many rows as the first: a row is rewritten a few times, not every few writes. A
transaction reads the manifest once, writes layers of its own, checks what it changed (required columns, checks, keys,
references, after cascades), and commits all tables by one atomic rename of the manifest. Nothing that readers use is
ever overwritten. A transaction that fails, or that loses to another one, leaves files that no manifest names.

The manifest and its lock are small files on a file system that all writers share; layers are read and written by Spark.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans.compile import quoted
from sparkloom.refusal import AlreadyThere, BrokenRule, Conflict, Fault, Refusal
from sparkloom.sources.tables import Table, broken, repeated
from sparkloom.sources.writes import completed

COMPACT = 8
MANIFEST, LOCK = "_manifest.json", "_lock"


@dataclass
class Snapshot:
    """What one manifest says."""

    version: int
    tables: dict[str, dict]

    @classmethod
    def read(cls, root: str) -> Snapshot:
        path = os.path.join(root, MANIFEST)
        if not os.path.exists(path):
            return cls(0, {})
        with open(path) as f:
            raw = json.load(f)
        return cls(raw["version"], raw["tables"])


@contextlib.contextmanager
def locked(root: str, seconds: float = 10.0, name: str = LOCK) -> Iterator[None]:
    """An exclusive lock on a file; waits for it, then gives up. The system lets go of it when its owner ends, however it ends."""
    path, until = os.path.join(root, name), time.monotonic() + seconds
    with open(path, "a") as f:
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > until:
                    raise Conflict(f"{path} is held by another writer") from None
                time.sleep(0.05)
        yield


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)
        self.known: dict[str, Table] = {}
        self.open: Transaction | None = None

    def describes(self, *tables: Table) -> Store:
        """States the rules of tables: keys, references, checks."""
        self.known |= {t.name: t for t in tables}
        return self

    def table(self, name: str) -> DataFrame:
        """The rows now, or as the open transaction sees them."""
        snapshot = self.open.snapshot if self.open else Snapshot.read(self.root)
        return self.read(snapshot, name)

    def read(self, snapshot: Snapshot, name: str) -> DataFrame:
        if name not in snapshot.tables:
            raise Refusal(f"there is no table {name}")
        own = snapshot.tables[name]
        schema = T.StructType.fromJson(own["schema"])
        df = None
        for layer in own["layers"]:
            if df is not None and own["key"]:
                # a layer's keys are few beside the table; Spark broadcasts them while they are small
                keys = self.spark.read.schema(T.StructType([schema[k] for k in own["key"]])).parquet(os.path.join(self.root, layer["path"]))
                df = df.join(keys, own["key"], "left_anti").select(*map(quoted, schema.names))
            if layer["kind"] == "rows":
                rows = self.spark.read.schema(schema).parquet(os.path.join(self.root, layer["path"]))
                df = rows if df is None else df.unionByName(rows)
        return self.spark.createDataFrame([], schema) if df is None else df

    def names(self) -> list[str]:
        return sorted((self.open.snapshot if self.open else Snapshot.read(self.root)).tables)

    def key(self, name: str) -> list[str]:
        return (self.open.snapshot if self.open else Snapshot.read(self.root)).tables[name]["key"]

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Joins the open transaction, if there is one; otherwise commits at the end, or abandons on an error."""
        if self.open is not None:
            yield self.open
            return
        self.open = Transaction(self, Snapshot.read(self.root))
        try:
            yield self.open
            self.open.commit()
        finally:
            self.open = None


@dataclass
class Transaction:
    store: Store
    snapshot: Snapshot
    touched: set[str] = field(default_factory=set)
    writes: int = 0

    def __post_init__(self):
        self.base = self.snapshot.version
        self.own: set[str] = set()
        self.snapshot = Snapshot(self.base, json.loads(json.dumps(self.snapshot.tables)))

    # definitions

    def create(self, table: Table, rows: DataFrame | None = None) -> None:
        if table.name in self.snapshot.tables:
            raise AlreadyThere(f"there is a table {table.name}")
        self.store.describes(table)
        self.snapshot.tables[table.name] = {"schema": table.schema().jsonValue(), "key": list(table.key), "layers": []}
        if rows is not None:
            self.insert(table.name, rows)

    def drop(self, name: str) -> None:
        if self.snapshot.tables.pop(name, None) is None:
            raise Refusal(f"there is no table {name}")

    def replace(self, name: str, df: DataFrame, table: Table | None = None) -> None:
        """The table whole, with another schema if ``table`` says so."""
        if table is not None:
            self.store.describes(table)
        key = list(table.key) if table else self.snapshot.tables[name]["key"]
        layer = self._write(name, df)
        self.snapshot.tables[name] = {"schema": T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]).jsonValue(), "key": key, "layers": [layer]}

    # rows

    def table(self, name: str) -> DataFrame:
        return self.store.read(self.snapshot, name)

    def _write(self, name: str, df: DataFrame, kind: str = "rows") -> dict:
        path = os.path.join(name, uuid.uuid4().hex)
        self.own.add(path)
        df.write.parquet(os.path.join(self.store.root, path))
        self.touched.add(name)
        self.writes += 1
        return {"kind": kind, "path": path}

    def _add(self, name: str, layer: dict) -> None:
        own = self.snapshot.tables[name]
        own["layers"].append(layer)
        if len(own["layers"]) > COMPACT:
            own["layers"] = self._merged(name, own)

    def _merged(self, name: str, own: dict) -> list[dict]:
        """The layers above the first as one of rows and one of keys that are gone; or all as one, if they are large beside it."""
        first, above = own["layers"][0], {**own, "layers": own["layers"][1:]}
        rows = self._write(name, self.store.read(Snapshot(self.base, {name: above}), name))
        n, held = (self.store.spark.read.parquet(os.path.join(self.store.root, x["path"])).count() for x in (rows, first))
        if not own["key"] or 2 * n >= held:
            return [self._write(name, self.table(name))]
        schema = T.StructType([self._schema(name)[k] for k in own["key"]])
        keys = self.store.spark.read.schema(schema).parquet(*[os.path.join(self.store.root, x["path"]) for x in above["layers"]])
        gone = self._write(name, keys.distinct(), "keys")  # those of rows that follow are no harm
        return [first, gone, rows]

    def _schema(self, name: str) -> T.StructType:
        if name not in self.snapshot.tables:
            raise Refusal(f"there is no table {name}")
        return T.StructType.fromJson(self.snapshot.tables[name]["schema"])

    def insert(self, name: str, rows: DataFrame) -> int:
        """New rows; a key that is there already, or twice among them, is refused."""
        table, key = self.store.known.get(name), self.snapshot.tables[name]["key"] if name in self.snapshot.tables else []
        rows = completed(self.store.spark.createDataFrame([], self._schema(name)), rows)
        if table:
            for column, value in table.defaults.items():
                rows = rows.withColumn(column, F.coalesce(quoted(column), (F.current_timestamp() if value == "now" else F.lit(value)).cast(rows.schema[column].dataType)))
        if key:
            layer = self._write(name, rows)
            written = self.store.spark.read.schema(rows.schema).parquet(os.path.join(self.store.root, layer["path"]))
            if self.table(name).join(written.select(*map(quoted, key)), key, "left_semi").limit(1).collect():
                raise AlreadyThere(f"{name} has the key already")
            n = written.count()
            if n != written.select(*map(quoted, key)).distinct().count():
                raise AlreadyThere(f"{name} is given a key twice")
        else:
            layer = self._write(name, rows)
            n = self.store.spark.read.parquet(os.path.join(self.store.root, layer["path"])).count()
        self._add(name, layer)
        return n

    def upsert(self, name: str, rows: DataFrame, key: Sequence[str] | None = None) -> int:
        """Rows added or replaced by key; columns that aren't given keep their values."""
        own = self.snapshot.tables[name]["key"] if name in self.snapshot.tables else []
        key = list(key or own)
        if not own:
            raise Refusal(f"{name} has no key to upsert by")
        old = self.table(name)
        missing = [c for c in old.columns if c not in rows.columns]
        if set(key) != set(own) and not set(own) <= set(rows.columns):
            raise Refusal(f"an upsert of {name} by another key needs its own key too")
        if not set(rows.columns) - set(key) and missing:
            # nothing but keys: those that are there stay as they are
            rows = rows.join(old.select(*map(quoted, key)), key, "left_anti")
        elif missing:
            kept = old.select(*map(quoted, key), *[F.col(quoted(c)) for c in missing if c not in key])
            rows = rows.join(kept, key, "left")
        rows = completed(old, rows)
        layer = self._write(name, rows)
        self._add(name, layer)
        return self.store.spark.read.parquet(os.path.join(self.store.root, layer["path"])).count()

    def delete(self, name: str, keys: DataFrame) -> int:
        """Rows of the given keys go, and what refers to them goes, is emptied, or forbids it."""
        own = self.snapshot.tables[name]["key"]
        if not own:
            raise Refusal(f"{name} has no key to delete by")
        gone = self.table(name).join(keys.select(*map(quoted, own)).distinct(), own, "left_semi")
        layer = self._write(name, gone.select(*map(quoted, own)), "keys")
        written = self.store.spark.read.schema(T.StructType([self._schema(name)[k] for k in own])).parquet(os.path.join(self.store.root, layer["path"]))
        n = written.count()
        if not n:
            return 0
        self._add(name, layer)  # before what refers to it: rows that refer to each other end here
        for child in list(self.store.known.values()):
            if child.name not in self.snapshot.tables:
                continue
            for ref in child.foreign_keys:
                if ref.table != name:
                    continue
                renamed = written.select(*[F.col(quoted(k)).alias(c) for c, k in zip(ref.columns, ref.keys, strict=True)])
                hit = self.table(child.name).join(renamed, list(ref.columns), "left_semi")
                if ref.on_delete == "cascade":
                    self.delete(child.name, hit)
                elif ref.on_delete == "set null":
                    if hit.limit(1).collect():
                        self.upsert(child.name, hit.select(*[(F.lit(None).cast(f.dataType) if f.name in ref.columns else F.col(quoted(f.name))).alias(f.name) for f in hit.schema.fields]))
                elif hit.limit(1).collect():
                    raise BrokenRule(f"{child.name} refers to rows of {name} that would go")
        return n

    # the end

    def _changed(self, name: str, schema: T.StructType) -> DataFrame | None:
        """The rows that this transaction wrote and that are still there; None if it only removed some."""
        paths = [x["path"] for x in self.snapshot.tables[name]["layers"] if x["kind"] == "rows" and x["path"] in self.own]
        if not paths:
            return None
        return self.store.spark.read.schema(schema).parquet(*[os.path.join(self.store.root, p) for p in paths])

    def check(self) -> None:
        """Rules over what changed: a small change is held against keys of the table, but never reads all of it."""
        for name in sorted(self.touched & set(self.snapshot.tables)):
            table, schema = self.store.known.get(name), self._schema(name)
            rows = self._changed(name, schema)
            if table is None or rows is None:
                continue
            current = self.table(name)
            for key in (table.key, *table.unique):
                known = " AND ".join(f"{quoted(k)} IS NOT NULL" for k in key)
                touched = rows.filter(known).select(*map(quoted, key)).distinct()
                if key and repeated(key, current.select(*map(quoted, key)).join(touched, list(key), "left_semi")):
                    raise AlreadyThere(f"{name} has two rows of one ({', '.join(key)})")
            if why := broken(table, rows):
                raise BrokenRule(why)
            for ref in table.foreign_keys:
                if ref.table in self.snapshot.tables:
                    there = self.table(ref.table).select(*[F.col(quoted(k)).alias(c) for c, k in zip(ref.columns, ref.keys, strict=True)])
                    own = rows.filter(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in ref.columns)).select(*map(quoted, ref.columns)).distinct()
                    if own.join(there, list(ref.columns), "left_anti").limit(1).collect():
                        raise BrokenRule(f"{name} ({', '.join(ref.columns)}) refers to rows that {ref.table} doesn't have")

    def commit(self) -> None:
        self.check()
        root = self.store.root
        with locked(root):
            if Snapshot.read(root).version != self.base:
                raise Conflict("another transaction committed first")
            path = os.path.join(root, f"{MANIFEST}.{uuid.uuid4().hex}")
            with open(path, "w") as f:
                json.dump({"version": self.base + 1, "tables": self.snapshot.tables}, f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(path, os.path.join(root, MANIFEST))


def transact(store: Store, work: Callable[[Transaction], object], tries: int = 3) -> object:
    """Runs ``work`` in a transaction, again if another one committed first."""
    for attempt in range(tries):
        try:
            with store.transaction() as t:
                return work(t)
        except Conflict:
            if attempt == tries - 1 or store.open is not None:
                raise
    raise Fault("no attempt was made")


def rows_of(store: Store, name: str, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """Python values as rows of a table; columns that no row names are left out."""
    schema = store._schema(name) if isinstance(store, Transaction) else T.StructType.fromJson(Snapshot.read(store.root).tables[name]["schema"])
    used = [f for f in schema.fields if any(f.name in r for r in rows)]
    unknown = sorted({k for r in rows for k in r} - set(schema.names))
    if unknown:
        raise Refusal(f"{name} has no column {', '.join(unknown)}")
    spark = store.store.spark if isinstance(store, Transaction) else store.spark
    free = T.StructType([T.StructField(f.name, f.dataType, True) for f in used])
    return spark.createDataFrame([tuple(r.get(f.name) for f in used) for r in rows], free)
