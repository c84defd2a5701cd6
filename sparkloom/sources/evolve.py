"""Histories of a structure: versions, the changes between them, and rows carried over them, both ways.

A change is a transformation of a DataFrame's schema and rows with, where it states one, its inverse. Carrying rows over
many versions is one plan: projections that Catalyst collapses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans.compile import quoted
from sparkloom.refusal import Irreversible, Refusal


def data_type(name: str | T.DataType) -> T.DataType:
    return name if isinstance(name, T.DataType) else T._parse_datatype_string(name)


class Change:
    def schema(self, s: T.StructType) -> T.StructType:
        raise NotImplementedError

    def rows(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def describe(self) -> str:
        parts = ", ".join(f"{k} {getattr(v, 'simpleString', lambda v=v: v)()}" for k, v in vars(self).items() if v is not None and not callable(v))
        return f"{type(self).__name__.lower()} of {parts}"

    def inverse(self, before: T.StructType) -> Change:
        """What undoes this on rows whose schema was ``before``."""
        raise NotImplementedError


def _field(s: T.StructType, name: str) -> T.StructField:
    for f in s.fields:
        if f.name == name:
            return f
    raise Refusal(f"there is no field {name}")


def _without(s: T.StructType, *names: str) -> T.StructType:
    for n in names:
        _field(s, n)
    return T.StructType([f for f in s.fields if f.name not in names])


def _free(s: T.StructType, name: str) -> None:
    if any(f.name == name for f in s.fields):
        raise Refusal(f"there is a field {name} already")


@dataclass(frozen=True)
class Addition(Change):
    """A new field: optional, with a default, or computed from the row. A required one needs one of the last two."""

    name: str
    type: str | T.DataType
    optional: bool = False
    default: object = None
    computed: Callable[[], object] | None = None
    at: int | None = None

    def schema(self, s):
        _free(s, self.name)
        if not self.optional and self.default is None and self.computed is None:
            raise Refusal(f"the new field {self.name} is required and has neither default nor computation")
        fields = list(s.fields)
        fields.insert(len(fields) if self.at is None else self.at, T.StructField(self.name, data_type(self.type), self.optional))
        return T.StructType(fields)

    def rows(self, df):
        value = self.computed() if self.computed else F.lit(self.default)
        order = [f.name for f in self.schema(df.schema).fields]
        return df.withColumn(self.name, value.cast(data_type(self.type))).select(*map(quoted, order))

    def inverse(self, before):
        return Removal(self.name)


@dataclass(frozen=True)
class Removal(Change):
    """A field goes; coming back, it is optional and empty."""

    name: str

    def schema(self, s):
        return _without(s, self.name)

    def rows(self, df):
        _field(df.schema, self.name)
        return df.drop(self.name)

    def inverse(self, before):
        f = _field(before, self.name)
        return Addition(self.name, f.dataType, optional=True, at=before.names.index(self.name))


@dataclass(frozen=True)
class Rename(Change):
    old: str
    new: str

    def schema(self, s):
        _field(s, self.old)
        _free(s, self.new)
        return T.StructType([T.StructField(self.new, f.dataType, f.nullable) if f.name == self.old else f for f in s.fields])

    def rows(self, df):
        self.schema(df.schema)
        return df.withColumnRenamed(self.old, self.new)

    def inverse(self, before):
        return Rename(self.new, self.old)


@dataclass(frozen=True)
class Retype(Change):
    """Another type, by cast, or by stated conversions of the column."""

    name: str
    type: str | T.DataType
    forward: Callable | None = None
    back: Callable | None = None

    def schema(self, s):
        _field(s, self.name)
        return T.StructType([T.StructField(f.name, data_type(self.type), f.nullable) if f.name == self.name else f for f in s.fields])

    def rows(self, df):
        _field(df.schema, self.name)
        c = F.col(quoted(self.name))
        return df.withColumn(self.name, (self.forward(c) if self.forward else c).cast(data_type(self.type)))

    def inverse(self, before):
        if self.forward and not self.back:
            raise Irreversible(f"the change of {self.name}'s type states no way back")
        return Retype(self.name, _field(before, self.name).dataType, self.back, self.forward)


@dataclass(frozen=True)
class Recomputation(Change):
    """Fields computed from others: additions, the computation over all, then removals. Without ``back`` there is no way back."""

    removed: tuple[str, ...]
    added: tuple[tuple[str, str | T.DataType], ...]
    forward: Callable[[DataFrame], DataFrame]
    back: Callable[[DataFrame], DataFrame] | None = None

    def schema(self, s):
        for n, _ in self.added:
            _free(s, n)
        out = _without(s, *self.removed)
        return T.StructType([*out.fields, *(T.StructField(n, data_type(t), True) for n, t in self.added)])

    def rows(self, df):
        wanted = self.schema(df.schema)
        for n, t in self.added:
            df = df.withColumn(n, F.lit(None).cast(data_type(t)))
        return self.forward(df).select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in wanted.fields])

    def inverse(self, before):
        if self.back is None:
            raise Irreversible("the recomputation states no way back")
        lost = tuple((n, _field(before, n).dataType) for n in self.removed)
        return Recomputation(tuple(n for n, _ in self.added), lost, self.back, self.forward)


@dataclass(frozen=True)
class Stage:
    """One version: how it is reached from the one before, and its schema."""

    version: str
    changes: tuple[Change, ...]
    schema: T.StructType


@dataclass(frozen=True)
class History:
    name: str
    stages: tuple[Stage, ...]
    faults: tuple[str, ...] = ()

    @classmethod
    def start(cls, name: str, version: str, schema: T.StructType) -> History:
        return cls(name, (Stage(version, (), schema),), () if name and version else ("a history needs a name and a version",))

    def then(self, version: str, *changes: Change) -> History:
        """The next version. What is wrong with it is kept on the history and refused when it is used."""
        faults, schema = list(self.faults), self.stages[-1].schema
        if version in self.versions():
            faults.append(f"{self.name} has the version {version} twice")
        if not changes:
            faults.append(f"version {version} of {self.name} changes nothing")
        try:
            for c in changes:
                schema = c.schema(schema)
        except Refusal as e:
            faults += [f"version {version} of {self.name}: {r}" for r in e.reasons]
        return replace(self, stages=(*self.stages, Stage(version, changes, schema)), faults=tuple(faults))

    def versions(self) -> list[str]:
        return [s.version for s in self.stages]

    def latest(self) -> Stage:
        return self.stages[-1]

    def at(self, version: str) -> Stage:
        return self.stages[self.place(version)]

    def place(self, version: str) -> int:
        if self.faults:
            raise Refusal(*self.faults)
        if version not in self.versions():
            raise Refusal(f"{self.name} has no version {version}")
        return self.versions().index(version)

    def between(self, here: str, there: str) -> list[Change]:
        """The changes from one version to another; backward, the inverses in reverse."""
        a, z = self.place(here), self.place(there)
        if a <= z:
            return [c for s in self.stages[a + 1 : z + 1] for c in s.changes]
        out = []
        for i in range(a, z, -1):
            schema, steps = self.stages[i - 1].schema, []
            for c in self.stages[i].changes:
                steps.append(c.inverse(schema))
                schema = c.schema(schema)
            out += steps[::-1]
        return out

    def statements(self, here: str, there: str) -> list[str]:
        """What a migration between two versions does, a line for each change."""
        return [c.describe() for c in self.between(here, there)]

    def validate(self, described: T.StructType) -> str | None:
        """The first difference between the latest version and a description, if any."""
        if self.faults:
            raise Refusal(*self.faults)
        own = {f.name: f for f in self.latest().schema.fields}
        for f in described.fields:
            if f.name not in own:
                return f"{self.name} is described with {f.name}, which its history doesn't have"
            if own[f.name].dataType != f.dataType:
                return f"{self.name}.{f.name} is described as {f.dataType.simpleString()}, its history says {own[f.name].dataType.simpleString()}"
            if own[f.name].nullable != f.nullable:
                return f"{self.name}.{f.name} is described as {'optional' if f.nullable else 'required'}, its history says the opposite"
        extra = [n for n in own if n not in described.names]
        return f"{self.name}'s history has {extra[0]}, which isn't described" if extra else None


def migrate_rows(history: History, df: DataFrame, here: str, there: str) -> DataFrame:
    """All rows carried from one version to another."""
    for c in history.between(here, there):
        df = c.rows(df)
    return df


def migrate_value(history: History, engine, value: dict, here: str, there: str) -> Row:
    """One value carried from one version to another."""
    df = engine.spark.createDataFrame([value], history.at(here).schema)
    return migrate_rows(history, df, here, there).first()
