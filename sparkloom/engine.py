"""An engine: a Spark session, where its tables are, and what its operations mean."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from string import Formatter

from pyspark.sql import Column, DataFrame, Row, SparkSession

from sparkloom.operators.expr import Expr
from sparkloom.operators.operations import Builder, Operation, Registry
from sparkloom.plans.compile import Compiler, Scope
from sparkloom.plans.select import SelectQuery, Source
from sparkloom.plans.statement import Statement
from sparkloom.refusal import NoRows, Refusal, SeveralRows
from sparkloom.sources.parquet import ParquetFolder
from sparkloom.streaming import pulled


class Engine:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | ParquetFolder | object, registry: Registry | None = None):
        """``tables``: DataFrames by name, or anything with ``table(name)``."""
        self.spark, self.tables, self.registry = spark, tables, registry or Registry()

    def also(self, taught: dict[Operation, Builder]) -> Engine:
        return Engine(self.spark, self.tables, self.registry.also(taught))

    def table(self, name: str) -> DataFrame:
        if isinstance(self.tables, Mapping):
            if name not in self.tables:
                raise Refusal(f"there is no table {name}")
            return self.tables[name]
        return self.tables.table(name)

    def compile(self, query: SelectQuery) -> DataFrame:
        return Compiler(self.table, self.registry).query(query)

    def rows(self, query: SelectQuery) -> Iterator[Row]:
        """Rows as they are pulled, a partition at a time; stopping early leaves the rest unread."""
        return pulled(self.compile(query))

    def row(self, query: SelectQuery) -> Row:
        """The one row; two are asked for, to tell one from several."""
        return only(self.compile(query))

    def query(self, sql: str | Statement, *args: object) -> DataFrame:
        """Hand-written SQL with bound ``?`` values; ``{name}`` is a table of this engine."""
        if isinstance(sql, Statement):
            if sql.why:
                raise Refusal(*sql.why)
            sql, args = sql.text, sql.values
        named = {name: self.table(name) for _, name, _, _ in Formatter().parse(sql) if name}
        return self.spark.sql(sql, args=list(args) or None, **named)

    def query_row(self, sql: str | Statement, *args: object) -> Row:
        return only(self.query(sql, *args))

    def column(self, source: Source, e: Expr) -> Column:
        """A compiled criterion or computation over a source, for use beside hand-written DataFrame code on ``table(...).alias(label)``."""
        if why := [*source.reasons(), *e.reasons()]:
            raise Refusal(*why)
        return Compiler(self.table, self.registry).column(e, Scope({source.label: self.table(source.name)}), {})

    def explain(self, query: SelectQuery) -> str:
        return self.compile(query)._jdf.queryExecution().toString()


def only(df: DataFrame) -> Row:
    rows = df.limit(2).collect()
    if not rows:
        raise NoRows("no row where one was asked for")
    if len(rows) > 1:
        raise SeveralRows("several rows where one was asked for")
    return rows[0]
