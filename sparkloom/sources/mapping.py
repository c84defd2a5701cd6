"""Nested values and flat tables: value objects as columns, entities beneath as tables of their own.

Value objects become columns named ``field_member``, at any depth; a nullable one is absent again if all its members are
null. Lists of entities become child tables keyed by their parent; they are gathered with one aggregation per child table.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans.compile import quoted

Child = tuple[DataFrame, Mapping[str, str], Sequence[str]]


def snake_case(name: str) -> str:
    """``fallbackArtwork`` to ``fallback_artwork``; runs of capitals stay one word."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


@dataclass(frozen=True)
class Naming:
    """Names of columns: snake case, unless one is stated."""

    columns: Mapping[str, str] = None  # type: ignore[assignment]

    def of(self, path: str) -> str:
        stated = self.columns or {}
        return stated.get(path) or "_".join(snake_case(p) for p in path.split("."))


def _leaves(schema: T.StructType, documents: frozenset[str], prefix: str = "") -> list[tuple[str, T.DataType]]:
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType) and path not in documents:
            out += _leaves(f.dataType, documents, f"{path}.")
        else:
            out.append((path, f.dataType))
    return out


def _path(path: str) -> Column:
    return F.col(".".join(quoted(p) for p in path.split(".")))


def columns_of(schema: T.StructType, naming: Naming | None = None, documents: Sequence[str] = ()) -> list[str]:
    """The flat columns of a described value, in its order."""
    naming = naming or Naming()
    return [naming.of(p) for p, _ in _leaves(schema, frozenset(documents))]


def arguments_of(schema: T.StructType, value: Mapping[str, object], documents: Sequence[str] = ()) -> list[object]:
    """A value's members in the order of ``columns_of``; what is absent is None."""
    out = []
    for path, _ in _leaves(schema, frozenset(documents)):
        v: object = value
        for part in path.split("."):
            v = v.get(part) if isinstance(v, Mapping) else None
        out.append(v)
    return out


def flattened(df: DataFrame, naming: Naming | None = None, documents: Sequence[str] = ()) -> DataFrame:
    """Value objects as columns; those listed in ``documents`` stay one column."""
    naming = naming or Naming()
    return df.select(*[_path(p).alias(naming.of(p)) for p, _ in _leaves(df.schema, frozenset(documents))])


def unflattened(df: DataFrame, schema: T.StructType, naming: Naming | None = None, documents: Sequence[str] = ()) -> DataFrame:
    """The nested rows again. Columns that the schema doesn't know are skipped."""
    naming, whole = naming or Naming(), frozenset(documents)

    def build(f: T.StructField, path: str) -> Column:
        if not isinstance(f.dataType, T.StructType) or path in whole:
            return F.col(quoted(naming.of(path))).cast(f.dataType)
        made = F.struct(*[build(m, f"{path}.{m.name}").alias(m.name) for m in f.dataType.fields])
        if not f.nullable:
            return made
        absent = F.lit(True)
        for p, _ in _leaves(f.dataType, whole, f"{path}."):
            absent = absent & F.col(quoted(naming.of(p))).isNull()
        return F.when(~absent, made)

    return df.select(*[build(f, f.name).alias(f.name) for f in schema.fields])


def assembled(root: DataFrame, children: Mapping[str, Child]) -> DataFrame:
    """``root`` with a list column for each child: (rows, {child column: root column}, order). Order columns lead the elements."""
    out = root
    for name, (rows, key, order) in children.items():
        rest = [c for c in rows.columns if c not in key and c not in order]
        element = F.struct(*[F.col(quoted(c)) for c in (*order, *rest)])
        lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(element)).alias(name))
        lists = lists.select(*[F.col(quoted(c)).alias(f"_key_{i}") for i, c in enumerate(key)], F.col(quoted(name)))
        on = [F.col(quoted(r)) == F.col(f"_key_{i}") for i, r in enumerate(key.values())]
        kind = lists.schema[name].dataType
        out = out.join(lists, on, "left").select(*[F.col(quoted(c)) for c in out.columns], F.coalesce(F.col(quoted(name)), F.array().cast(kind)).alias(name))
    return out


def taken_apart(df: DataFrame, key: Sequence[str], lists: Sequence[str], position: str = "") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The root without its lists, and each list as a child table with the root's key (and the place, if a column is named for it)."""
    parts = {}
    for name in lists:
        own = [F.col(quoted(k)) for k in key]
        if position:
            rows = df.select(*own, F.posexplode(quoted(name)).alias(position, "_element"))
            parts[name] = rows.select(*own, position, "_element.*")
        else:
            parts[name] = df.select(*own, F.explode(quoted(name)).alias("_element")).select(*own, "_element.*")
    return df.drop(*lists), parts


def represented(df: DataFrame, column: str, convert) -> DataFrame:
    """A column in another representation; ``convert`` maps a Column to a Column."""
    return df.withColumn(column, convert(F.col(quoted(column))))
