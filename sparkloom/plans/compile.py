"""From a SelectQuery to a DataFrame: a logical plan only, so Catalyst chooses every physical step.

Order: named queries, from, joins, filter, aggregation, having, windows, sort, offset, limit, projection. The sort comes
before the projection, so that an order may use what isn't selected.

Aggregation: every distinct aggregate outside a window, of select, having and order, becomes one hidden column; so does
every grouping expression. What remains of the expressions is then built over those. Subqueries are DataFrames whose
references to enclosing sources are marked as outer, which Catalyst turns into joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as SparkWindow

from sparkloom.kinds import Kind, kind_of
from sparkloom.operators import operations as op
from sparkloom.operators.expr import Apply, Col, Expr, Nulls, Ordering, Over, Refused, Sub, Unsaid, Val, aggregates_of
from sparkloom.operators.operations import Registry
from sparkloom.plans.select import SelectQuery, Source
from sparkloom.refusal import Refusal

Tables = Callable[[str], DataFrame]

#: How parts of an aggregate are put together.
COMBINED = {op.ROW_COUNT: F.sum, op.VALUE_COUNT: F.sum, op.SUMMATION: F.sum, op.WHOLE_TOTAL: F.sum, op.MAXIMUM: F.max, op.MINIMUM: F.min}
#: Ranges that the distinct order values of a window over all rows are cut into.
RANGES = 256


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Scope:
    """The sources a query sees: its own by label, and those of the queries around it."""

    def __init__(self, own: dict[str, DataFrame], outer: Scope | None = None):
        self.own, self.outer = own, outer

    def depth(self, label: str) -> int | None:
        if label in self.own:
            return 0
        up = self.outer.depth(label) if self.outer else None
        return None if up is None else up + 1

    def kind(self, c: Col) -> Kind:
        """From the data itself where it is known, else as declared."""
        scope: Scope | None = self
        while scope:
            for label, df in scope.own.items():
                if c.source in (None, label) and c.name in df.columns:
                    return kind_of(df.schema[c.name].dataType)
            scope = scope.outer
        return c.kind

    def type(self, c: Col) -> T.DataType | None:
        for label, df in self.own.items():
            if c.source in (None, label) and c.name in df.columns:
                return df.schema[c.name].dataType
        return self.outer.type(c) if self.outer else None


class Compiler:
    def __init__(self, tables: Tables, registry: Registry):
        self.tables, self.registry = tables, registry

    # queries

    def query(self, q: SelectQuery, ctes: dict[str, DataFrame] | None = None, outer: Scope | None = None) -> DataFrame:
        if outer is None and (why := q.reasons()):
            raise Refusal(*why)
        named = dict(ctes or {})
        for c in q.with_:
            named[c.name] = self.query(c.query, named, outer)
        own = {s.label: self.source(s, named, outer) for s in q.sources()}
        scope = Scope(own, outer)
        df = own[q.source.label].alias(q.source.label)
        for j in q.joins:
            right = own[j.source.label].alias(j.source.label)
            df = df.join(right, F.lit(True) if j.on.unsaid else self.column(j.on, scope, named), j.how)
        where = q.filter()
        if not where.unsaid:
            df = df.filter(self.column(where, scope, named))
        hidden: dict[tuple, str] = {}
        said = [s.expr for s in q.selections()] + ([] if q.having.unsaid else [q.having]) + [o.expr for o in q.order_by]
        found = {a.identity(): a for e in said for a in aggregates_of(e)}
        if q.group_by or found:
            groups = {g.identity(): g for g in q.group_by}
            keys = [self.column(g, scope, named).alias(f"_g{i}") for i, g in enumerate(groups.values())]
            aggs = [self.column(a, scope, named).alias(f"_a{i}") for i, a in enumerate(found.values())]
            hidden = {k: f"_g{i}" for i, k in enumerate(groups)} | {k: f"_a{i}" for i, k in enumerate(found)}
            if not aggs:
                df = df.select(*keys).distinct()
            else:
                # without keys a projection of aggregates is one row; unlike agg() it may hold references to outer queries
                df = df.groupBy(*keys).agg(*aggs) if keys else df.select(*aggs)
            if not q.having.unsaid:
                df = df.filter(self.column(q.having, scope, named, hidden))
        elif not q.having.unsaid:
            df = df.filter(self.column(q.having, scope, named))
        windows = {w.identity(): w for e in [*(s.expr for s in q.selections()), *(o.expr for o in q.order_by)] for w in self._windows(e)}
        for i, (k, w) in enumerate(windows.items()):
            if outer is None and self._combines(w):
                df = self._running(df, w, f"_w{i}", scope, named, hidden)
            else:
                df = df.withColumn(f"_w{i}", self.column(w, scope, named, hidden))
            hidden[k] = f"_w{i}"
        if q.order_by:
            df = df.orderBy(*[self.ordering(o, scope, named, hidden) for o in q.order_by])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit:
            df = df.limit(q.limit)
        return df.select(*[self.column(s.expr, scope, named, hidden).alias(s.name) for s in q.selections()])

    def source(self, s: Source, named: dict[str, DataFrame], outer: Scope | None) -> DataFrame:
        if s.query is not None and not s.named:
            return self.query(s.query, named, outer)
        return named[s.name] if s.name in named else self.tables(s.name)

    def _windows(self, e: Expr) -> list[Over]:
        return [e] if isinstance(e, Over) else [w for c in e.children() for w in self._windows(c)]

    def _combines(self, w: Over) -> bool:
        """A window over all rows whose aggregate can be put together from parts."""
        return not w.window.partition_by and isinstance(w.expr, Apply) and w.expr.op in COMBINED and w.expr.op not in self.registry.taught and op.OVER_WINDOW not in self.registry.taught

    def _running(self, df: DataFrame, w: Over, name: str, scope: Scope, named: dict[str, DataFrame], hidden: dict[tuple, str]) -> DataFrame:
        """A window without partitions, without sending all rows to one task.

        Without an order it is one value of all rows: a scalar subquery. With one it depends on the order's values alone, as
        peers share it: rows are aggregated by those values, the window runs over the distinct values, and joins back. The
        distinct values are cut into ranges of the first order value, at a sample of them: the window runs inside each range,
        and what the ranges before add up to is put before it. Values that share the first order value are in one range.
        """
        part = self._applied(w.expr, scope, named, hidden)
        if not w.window.order_by:
            return df.withColumn(name, self._finished(w.expr, df.select(part.alias("_p")).scalar()))
        orders = [self.column(o.expr, scope, named, hidden) for o in w.window.order_by]
        keys = [f"{name}_k{j}" for j in range(len(orders))]
        values = df.groupBy(*[c.alias(k) for c, k in zip(orders, keys, strict=True)]).agg(part.alias("_p"))
        by = [self.ordering(Ordering(Col(k), o.descending, o.nulls), Scope({}), {}) for k, o in zip(keys, w.window.order_by, strict=True)]
        first, combine = w.window.order_by[0], COMBINED[w.expr.op]
        marks = values.filter(F.col(keys[0]).isNotNull()).orderBy(F.xxhash64(*keys), *keys).limit(RANGES - 1).agg(F.collect_list(keys[0])).scalar()
        beyond = F.array_position(F.sort_array(F.array_append(marks, F.col(keys[0]))), F.col(keys[0])).cast("int") - 1  # marks below the value
        nulls_first = first.nulls is Nulls.FIRST or (first.nulls is Nulls.UNSTATED and not first.descending)
        place = F.when(F.col(keys[0]).isNull(), F.lit(-1 if nulls_first else RANGES)).otherwise(F.lit(RANGES - 1) - beyond if first.descending else beyond)
        ranged = values.withColumn("_range", place)
        before = combine("_whole").over(SparkWindow.orderBy("_range").rowsBetween(SparkWindow.unboundedPreceding, -1))
        wholes = ranged.groupBy("_range").agg(combine("_p").alias("_whole")).select(F.col("_range").alias("_of"), before.alias("_before"))  # RANGES rows and two at most
        own = combine("_p").over(SparkWindow.partitionBy("_range").orderBy(*by)).alias("_own")
        running = ranged.select(*keys, "_range", own).join(F.broadcast(wholes), F.col("_range") == F.col("_of"))
        together = {F.max: F.greatest, F.min: F.least}.get(combine, lambda x, y: F.coalesce(x + y, x, y))
        values = running.select(*keys, self._finished(w.expr, together(F.col("_before"), F.col("_own"))).alias(name))
        same = F.lit(True)
        for c, k in zip(orders, keys, strict=True):
            same = same & c.eqNullSafe(F.col(k))
        return df.join(values, same)

    # expressions

    def kind(self, e: Expr, scope: Scope) -> Kind:
        if isinstance(e, Col):
            return scope.kind(e)
        if isinstance(e, Apply) and e.kind is Kind.UNKNOWN:
            kinds = {self.kind(a, scope) for a in e.args}
            return kinds.pop() if len(kinds) == 1 else Kind.UNKNOWN
        return e.kind

    def column(self, e: Expr, scope: Scope, named: dict[str, DataFrame], hidden: dict[tuple, str] | None = None) -> Column:
        if hidden and (name := hidden.get(e.identity())):
            return F.col(name)
        if isinstance(e, Col):
            return self._named(e, scope, bool(hidden and any(v.startswith("_g") or v.startswith("_a") for v in hidden.values())))
        if isinstance(e, Val):
            return self._value(e)
        if isinstance(e, Unsaid):
            return F.lit(True)
        if isinstance(e, Sub):
            return self.query(e.query, named, scope).scalar()
        if isinstance(e, Over):
            spec = SparkWindow.partitionBy(*[self.column(p, scope, named, hidden) for p in e.window.partition_by])
            if e.window.order_by:
                spec = spec.orderBy(*[self.ordering(o, scope, named, hidden) for o in e.window.order_by])
            out = self.registry.build(op.OVER_WINDOW, [self._applied(e.expr, scope, named, hidden)], [e.expr.kind], spec)
            return self._finished(e.expr, out)
        if isinstance(e, Apply):
            return self._finished(e, self._applied(e, scope, named, hidden))
        if isinstance(e, Refused):
            raise Refusal(*e.why)
        raise Refusal(f"{type(e).__name__} is no expression")

    def _finished(self, e: Expr, c: Column) -> Column:
        return e.op.finish(c, e.detail) if isinstance(e, Apply) and e.op.finish and e.op not in self.registry.taught else c

    def _applied(self, e: Expr, scope: Scope, named: dict[str, DataFrame], hidden: dict[tuple, str] | None) -> Column:
        if not isinstance(e, Apply):
            return self.column(e, scope, named, hidden)
        if e.op is op.NEGATION and (outside := self._outside(e, scope, named, hidden)) is not None:
            return outside
        if self.registry.builder(e.op) is None and e.op in (op.ONE_OF_QUERY, op.EXISTENCE):
            sub = self.query(e.args[-1].query, named, scope)
            return sub.exists() if e.op is op.EXISTENCE else self.column(e.args[0], scope, named, hidden).isin(sub.select(quoted(e.args[-1].query.selections()[0].name)))
        kinds = [self.kind(a, scope) for a in e.args]
        args = [self.column(a, scope, named, hidden) for a in e.args]
        typed = next((t for a in e.args if isinstance(a, Col) and (t := scope.type(a)) is not None), None)
        if isinstance(typed, T.TimestampNTZType):  # a bound moment is compared in the column's own type
            args = [c.cast("timestamp_ntz") if isinstance(a, Val) and a.kind is Kind.MOMENT else c for a, c in zip(e.args, args, strict=True)]
        return self.registry.build(e.op, args, kinds, e.detail)

    def _outside(self, e: Apply, scope: Scope, named: dict[str, DataFrame], hidden: dict[tuple, str] | None) -> Column | None:
        """NOT IN a query, without the null-aware join that sends all the query's rows to the driver: an anti join on equality,
        and null where no equal row was found but there is a null: among the query's rows, or as the term and the query has rows.

        None leaves it to Spark: what isn't that, a query or a term that refers to queries around, and a query whose rows may
        differ each time it runs, as it runs for each of the parts here.
        """
        inner = e.args[0] if len(e.args) == 1 else None
        while isinstance(inner, Apply) and inner.op is op.BRACKET and len(inner.args) == 1:
            inner = inner.args[0]
        if not isinstance(inner, Apply) or inner.op is not op.ONE_OF_QUERY or {op.NEGATION, op.BRACKET, op.ONE_OF_QUERY} & {*self.registry.taught}:
            return None
        member, query = inner.args[0], inner.args[-1].query
        if query.cuts() or not self._near(member, scope):
            return None
        try:
            sub = self.query(query, named, Scope({}))
        except Refusal:  # of a source that is around it; any other is raised again by the usual way
            return None
        if not sub._jdf.queryExecution().analyzed().deterministic():
            return None
        among = sub.select(F.col(quoted(query.selections()[0].name)).alias("_among")).alias("_of")  # no name of it hides one of the term's
        c = self.column(member, scope, named, hidden)
        unknown = among.filter(F.col("_among").isNull()).exists() | (c.isNull() & among.exists())
        equal = among.filter(F.col("_among").isNotNull()).filter(F.col("_among") == c.outer())  # nulls would all be dealt to one task
        return ~equal.exists() & F.when(unknown, F.lit(None)).otherwise(F.lit(True))

    def _near(self, e: Expr, scope: Scope) -> bool:
        """Whether an expression is of the query's own columns alone."""
        if isinstance(e, Col):
            return e.source is None or scope.depth(e.source) == 0
        return not isinstance(e, Sub) and all(self._near(c, scope) for c in e.children())

    def _named(self, c: Col, scope: Scope, grouped: bool) -> Column:
        if grouped:
            raise Refusal(f"{c.name} is neither grouped by nor aggregated")
        if c.source is None:
            return F.col(quoted(c.name))
        depth = scope.depth(c.source)
        if depth is None:
            raise Refusal(f"the query has no source {c.source}")
        out = F.col(f"{quoted(c.source)}.{quoted(c.name)}")
        return out.outer() if depth else out

    def _value(self, v: Val) -> Column:
        return F.lit(bytes(v.value) if isinstance(v.value, bytearray) else v.value)

    def ordering(self, o: Ordering, scope: Scope, named: dict[str, DataFrame], hidden: dict[tuple, str] | None = None) -> Column:
        """Always with a stated place of nulls; unstated, they come first ascending and last descending."""
        c = self.column(o.expr, scope, named, hidden)
        first = o.nulls is Nulls.FIRST or (o.nulls is Nulls.UNSTATED and not o.descending)
        return self.registry.build(op.NULLS_FIRST_ORDER if first else op.NULLS_LAST_ORDER, [c], [o.expr.kind], o.descending)
