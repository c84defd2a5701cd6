"""Writes as DataFrame transformations: the table as it would be afterwards. The store makes them durable.

A null condition is no match: such rows are kept by a delete and left alone by an update.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.engine import Engine
from sparkloom.operators.expr import Expr, param
from sparkloom.plans.compile import Compiler, Scope, quoted
from sparkloom.plans.select import Source
from sparkloom.refusal import AlreadyThere, Refusal
from sparkloom.sources.tables import repeated


def _known(table: DataFrame, columns: Sequence[str]) -> None:
    unknown = [c for c in columns if c not in table.columns]
    if unknown:
        raise Refusal(f"the table has no column {', '.join(unknown)}")


def completed(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the table's columns and types; those not given are null."""
    _known(table, rows.columns)
    return rows.select(*[(F.col(quoted(f.name)) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields])


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(completed(table, rows))


def upserted(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows replaced by key or added. Columns that ``rows`` doesn't have keep their values; rows of keys alone change nothing that is there. Two new rows of one key are refused."""
    _known(table, rows.columns)
    missing = [k for k in key if k not in rows.columns]
    if not key or missing:
        raise Refusal(f"an upsert needs its key: {', '.join(missing) or 'none is given'}")
    if repeated(key, rows):
        raise AlreadyThere(f"an upsert is given one ({', '.join(key)}) twice")
    new = rows.select(*[F.col(quoted(c)).cast(table.schema[c].dataType).alias(f"_new_{i}") for i, c in enumerate(rows.columns)], F.lit(True).alias("_new"))
    place = {c: f"_new_{i}" for i, c in enumerate(rows.columns)}
    kept = table.withColumn("_old", F.lit(True))
    on = [F.col(quoted(k)) == F.col(place[k]) for k in key]
    both = kept.join(new, on, "full")
    took = F.col("_new").isNotNull()
    return both.select(*[(F.when(took, F.col(place[c])).otherwise(F.col(quoted(c))) if c in place else F.col(quoted(c))).alias(c) for c in table.columns])


def _condition(engine: Engine, source: Source, where: Expr):
    if why := [*source.reasons(), *where.reasons()]:
        raise Refusal(*why)
    df = engine.table(source.name).alias(source.label)
    if where.unsaid:
        return df, F.lit(True)
    compiler = Compiler(engine.table, engine.registry)
    return df, F.coalesce(compiler.column(where, Scope({source.label: df}), {}), F.lit(False))


def updated(engine: Engine, source: Source, values: Mapping[str, object], where: Expr) -> DataFrame:
    """Given columns set to expressions or values where the criterion holds."""
    df, holds = _condition(engine, source, where)
    if not values:
        raise Refusal("an update sets nothing")
    _known(df, list(values))
    compiler, scope = Compiler(engine.table, engine.registry), Scope({source.label: df})
    new = {c: compiler.column(v if isinstance(v, Expr) else param(v), scope, {}).cast(df.schema[c].dataType) for c, v in values.items()}
    flagged = df.withColumn("_holds", holds)  # subqueries of the criterion become one join
    return flagged.select(*[F.when(F.col("_holds"), new[c]).otherwise(F.col(quoted(c))).alias(c) if c in new else F.col(quoted(c)) for c in df.columns])


def deleted(engine: Engine, source: Source, where: Expr) -> DataFrame:
    df, holds = _condition(engine, source, where)
    return df.filter(~holds)
