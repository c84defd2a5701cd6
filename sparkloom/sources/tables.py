"""Descriptions of aggregates, and the tables derived from them: columns, keys, references, rules.

An object with an identity is an entity and has a table; a value object is flattened into its owner's columns; a list of entities is a
child table keyed by the parent's key and the child's own, with a position; a list of references is a join table. What
cannot be derived is refused with every reason found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.kinds import Kind, kind_of
from sparkloom.operators.criteria import and_
from sparkloom.plans.compile import quoted
from sparkloom.plans.select import Join, Source, columns_equal, from_, inner_join, left_join
from sparkloom.refusal import Refusal
from sparkloom.sources.mapping import Naming

POSITION = "position"
LONGEST_NAME = 63


# descriptions


@dataclass(frozen=True)
class Rule:
    """One of: at_least, at_most, above, below, min_length, max_length, pattern."""

    name: str
    value: object

    def holds(self, c: Column) -> Column:
        v = self.value
        test = {
            "at_least": lambda: c >= F.lit(v),
            "at_most": lambda: c <= F.lit(v),
            "above": lambda: c > F.lit(v),
            "below": lambda: c < F.lit(v),
            "min_length": lambda: F.char_length(c) >= v,
            "max_length": lambda: F.char_length(c) <= v,
            "pattern": lambda: F.rlike(c, F.lit(v)),
        }
        if self.name not in test:
            raise Refusal(f"there is no rule {self.name}")
        return c.isNull() | test[self.name]()


@dataclass(frozen=True)
class Scalar:
    """text, boolean, bytes, timestamp, number32/64, int8 ... int64, uint8 ... uint64."""

    type: str
    rules: tuple[Rule, ...] = ()

    def data_type(self) -> T.DataType:
        plain = {"text": T.StringType(), "boolean": T.BooleanType(), "bytes": T.BinaryType(), "timestamp": T.TimestampType(), "number32": T.FloatType(), "number64": T.DoubleType()}
        if self.type in plain:
            return plain[self.type]
        if not self.type.lstrip("u").startswith("int"):
            raise Refusal(f"there is no scalar {self.type}")
        unsigned, bits = self.type.startswith("u"), int(self.type.lstrip("u")[3:])
        low = 0 if unsigned else -(1 << (bits - 1))
        high = (1 << bits) - 1 if unsigned else (1 << (bits - 1)) - 1
        stated = False
        for r in self.rules:  # a stated range may narrow the type
            if r.name in ("at_least", "above"):
                low, stated = max(low, r.value + (r.name == "above")), True
            if r.name in ("at_most", "below"):
                high, stated = min(high, r.value - (r.name == "below")), True
        if high >= 1 << 63:
            raise Refusal("an unsigned 64-bit integer fits no column; state a range that does")
        wide = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}
        if not stated:
            return wide[min(64, bits * 2) if unsigned else bits]
        return next(t for b, t in wide.items() if -(1 << (b - 1)) <= low and high < 1 << (b - 1))


@dataclass(frozen=True)
class Reference:
    to: str
    on_delete: str = "restrict"  # or cascade, set null


@dataclass(frozen=True)
class Sequence_:
    of: Object | Reference


@dataclass(frozen=True)
class Field:
    name: str
    type: Scalar | Reference | Sequence_ | Object
    identity: bool = False
    optional: bool = False
    computed: bool = False
    default: object = None
    unique: bool = False


@dataclass(frozen=True)
class Object:
    name: str
    fields: tuple[Field, ...]
    unique_keys: tuple[tuple[str, ...], ...] = ()
    documents: tuple[str, ...] = ()

    def identity(self) -> list[Field]:
        return [f for f in self.fields if f.identity]


# tables


@dataclass(frozen=True)
class Check:
    name: str
    column: str
    rule: Rule


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    keys: tuple[str, ...]
    on_delete: str = "restrict"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[tuple[str, T.DataType, bool], ...]  # name, type, nullable
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[Check, ...] = ()
    defaults: dict = field(default_factory=dict, compare=False, hash=False)
    computed: tuple[str, ...] = ()
    parent: str | None = None
    field: str | None = None  # of the parent's object
    single: bool = False

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, null) for n, t, null in self.columns])

    def source(self) -> Source:
        columns: list[tuple[str, Kind]] = [(n, kind_of(t)) for n, t, _ in self.columns]
        return from_(self.name, *columns)

    def statement(self) -> str:
        """The table as Spark DDL; what Spark's catalog cannot hold stays a comment, and the store enforces it."""
        lines = [f"  {quoted(n)} {t.simpleString()}{'' if null else ' NOT NULL'}" for n, t, null in self.columns]
        notes = [f"-- key ({', '.join(self.key)})"] + [f"-- unique ({', '.join(u)})" for u in self.unique]
        notes += [f"-- ({', '.join(f.columns)}) refers to {f.table} ({', '.join(f.keys)}), on delete {f.on_delete}" for f in self.foreign_keys]
        notes += [f"-- check {c.name}: {c.column} {c.rule.name} {c.rule.value}" for c in self.checks]
        return f"CREATE TABLE {quoted(self.name)} (\n" + ",\n".join(lines) + "\n) USING parquet\n" + "\n".join(notes)


def _check_name(table: str, column: str, rule: str) -> str:
    """Spelled out, or where that is too long the rule and a digest of the whole."""
    name = f"{table}_{column}_{rule}"
    return name if len(name.encode()) <= LONGEST_NAME else f"{rule}_{hashlib.sha256(name.encode()).hexdigest()[:24]}"


class Deriving:
    def __init__(self, objects: Sequence[Object], naming: Naming):
        self.known = {o.name: o for o in objects}
        self.naming, self.reasons, self.tables = naming, [], {}

    def key_of(self, name: str) -> list[tuple[str, T.DataType]]:
        o = self.known.get(name)
        if o is None:
            self.reasons.append(f"a reference is to {name}, which isn't described")
            return []
        return [(self.naming.of(f.name), f.type.data_type()) for f in o.identity() if isinstance(f.type, Scalar)]

    def object(self, o: Object, parent: Table | None = None, field_name: str | None = None, single: bool = False) -> None:
        if not o.name:
            self.reasons.append("an object has no name")
        own = o.identity()
        if not own:
            self.reasons.append(f"{o.name} has no identity")
        name = self.naming.of(o.name)
        if name in self.tables:
            self.reasons.append(f"two tables are called {name}")
            return
        columns, unique, keys, checks, defaults, computed, children = [], [], [], [], {}, [], []

        def add(f: Field, path: str, optional: bool) -> None:
            column, optional = self.naming.of(path), optional or f.optional
            if isinstance(f.type, Scalar):
                try:
                    columns.append((column, f.type.data_type(), optional))
                except Refusal as e:
                    self.reasons.extend(f"{o.name}.{path}: {r}" for r in e.reasons)
                for r in f.type.rules:
                    checks.append(Check(_check_name(name, column, r.name), column, r))
                if f.unique:
                    unique.append((column,))
                if f.default is not None:
                    defaults[column] = f.default
                if f.computed:
                    computed.append(column)
                    if f.default is None and not f.identity:
                        self.reasons.append(f"{o.name}.{path} is computed and has no default")
            elif isinstance(f.type, Reference):
                target = self.key_of(f.type.to)
                if len(target) > 1:
                    self.reasons.append(f"{o.name}.{path} refers to {f.type.to}, whose key has {len(target)} columns")
                if f.type.on_delete == "set null" and not optional:
                    self.reasons.append(f"{o.name}.{path} is required and cannot be set null")
                for _, t in target[:1]:
                    columns.append((column, t, optional))
                    keys.append(ForeignKey((column,), self.naming.of(f.type.to), tuple(k for k, _ in target), f.type.on_delete))
                if f.unique:
                    unique.append((column,))
            elif isinstance(f.type, Sequence_):
                children.append((f, path, False))
            elif f.type.identity():
                children.append((f, path, True))
            elif path in o.documents:
                columns.append((column, _document(f.type), optional))
            else:
                for m in f.type.fields:
                    add(m, f"{path}.{m.name}", optional)
                if f.unique:  # a value object is unique by all of its columns
                    unique.append(tuple(self.naming.of(f"{path}.{m.name}") for m in f.type.fields))

        for f in o.fields:
            add(f, f.name, False)
        key = tuple(self.naming.of(f.name) for f in own)
        if parent is not None:
            if len(parent.key) > 1 and parent.parent is None:
                self.reasons.append(f"{parent.name} has a composite key and children")
            types = {n: t for n, t, _ in parent.columns}
            up = tuple(f"{parent.name}_{k}" if not k.startswith(f"{parent.name}_") else k for k in parent.key)
            if parent.parent is not None:  # its own key holds its parent's already
                up = tuple(k if k not in {c[0] for c in columns} else f"{parent.name}_{k}" for k in up)
            columns += [(u, types[k], False) for u, k in zip(up, parent.key, strict=True)]
            keys.append(ForeignKey(up, parent.name, parent.key, "cascade"))
            key = (*up, *key)
            if single:
                unique.append(up)
            else:
                columns.append((POSITION, T.IntegerType(), False))
        names = [c[0] for c in columns]
        self.reasons += [f"{o.name} has two columns called {n}" for n in sorted({n for n in names if names.count(n) > 1})]
        unique += [tuple(self.naming.of(x) for x in u) for u in o.unique_keys]
        table = Table(name, tuple(columns), key, tuple(unique), tuple(keys), tuple(checks), defaults, tuple(computed), parent.name if parent else None, field_name, single)
        self.tables[name] = table
        for f, path, one in children:
            target = f.type.of if isinstance(f.type, Sequence_) else f.type
            if isinstance(target, Reference):
                self.join_table(table, path, target)
            elif isinstance(target, Object):
                self.object(target, table, path, one)
            else:
                self.reasons.append(f"{o.name}.{path} is a list of scalars; state it as a document")

    def join_table(self, owner: Table, path: str, target: Reference) -> None:
        name, there = f"{owner.name}_{self.naming.of(path)}", self.key_of(target.to)
        types = {n: t for n, t, _ in owner.columns}
        up = tuple(f"{owner.name}_{k}" for k in owner.key)
        other = tuple(f"{self.naming.of(target.to)}_{k}" for k, _ in there)
        columns = [(u, types[k], False) for u, k in zip(up, owner.key, strict=True)] + [(c, t, False) for c, (_, t) in zip(other, there, strict=True)] + [(POSITION, T.IntegerType(), False)]
        keys = (ForeignKey(up, owner.name, owner.key, "cascade"), ForeignKey(other, self.naming.of(target.to), tuple(k for k, _ in there), target.on_delete))
        self.tables[name] = Table(name, tuple(columns), (*up, *other), (), keys, parent=owner.name, field=path)


def _document(o: Object) -> T.StructType:
    def kind(t) -> T.DataType:
        if isinstance(t, Scalar):
            return t.data_type()
        if isinstance(t, Sequence_):
            return T.ArrayType(kind(t.of))
        return _document(t)

    return T.StructType([T.StructField(f.name, kind(f.type), f.optional) for f in o.fields])


def derive(*objects: Object, naming: Naming | None = None) -> dict[str, Table]:
    """Tables by name, in an order in which they can be made."""
    d = Deriving(objects, naming or Naming())
    for o in objects:
        d.object(o)
    if d.reasons:
        raise Refusal(*d.reasons)
    out, waiting = {}, dict(d.tables)
    while waiting:
        ready = [n for n, t in waiting.items() if all(k.table == n or k.table not in waiting for k in t.foreign_keys)] or list(waiting)[:1]
        for n in ready:
            out[n] = waiting.pop(n)
    return out


# joins by the one reference between two tables


def key_condition(left: Table, a: Source, right: Table, b: Source):
    found = [(f, True) for f in left.foreign_keys if f.table == right.name] + [(f, False) for f in right.foreign_keys if f.table == left.name]
    if len(found) != 1:
        raise Refusal(f"{left.name} and {right.name} have {len(found)} references between them where a join needs one")
    key, forward = found[0]
    near, far = (a, b) if forward else (b, a)
    return and_(*[columns_equal(near, c, far, k) for c, k in zip(key.columns, key.keys, strict=True)])


def join_by_key(left: Table, a: Source, right: Table, b: Source, joined: Source | None = None, how: str = "inner") -> Join:
    """A join of ``joined`` (the right one by default) on the reference between two tables, in either direction."""
    on = key_condition(left, a, right, b)
    return (inner_join if how == "inner" else left_join)(joined or b, on)


# rules over rows


def broken(table: Table, df: DataFrame) -> str | None:
    """The first rule that some row breaks: a required column, a check, the key or a unique key."""
    tests = [(f"{table.name}.{n} is required", F.col(quoted(n)).isNull()) for n, _, null in table.columns if not null]
    tests += [(f"{table.name} breaks the check {c.name}", ~c.rule.holds(F.col(quoted(c.column)))) for c in table.checks]
    if tests:
        row = df.agg(*[F.max(F.coalesce(t, F.lit(False)).cast("int")).alias(f"t{i}") for i, (_, t) in enumerate(tests)]).first()
        for i, (what, _) in enumerate(tests):
            if row[f"t{i}"]:
                return what
    return None


def repeated(key: Sequence[str], df: DataFrame) -> bool:
    """Whether some rows share the key. Keys with a null in them are not compared, as in SQL."""
    known = df.filter(" AND ".join(f"{quoted(k)} IS NOT NULL" for k in key))
    return bool(known.groupBy(*map(quoted, key)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).collect())


@dataclass(frozen=True)
class Index:
    """Columns by which a table is clustered when it is written; Spark has no index, but Parquet skips by statistics."""

    columns: tuple[str, ...]
    unique: bool = False
    include: tuple[str, ...] = ()

    def reasons(self) -> list[str]:
        return ["a unique index cannot include columns"] if self.unique and self.include else []

    def clustered(self, df: DataFrame, partitions: int) -> DataFrame:
        if why := self.reasons():
            raise Refusal(*why)
        columns = [F.col(quoted(c)) for c in self.columns]
        return df.repartitionByRange(partitions, *columns).sortWithinPartitions(*columns)
