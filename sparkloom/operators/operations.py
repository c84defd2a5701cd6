"""Operations by identity, each with a builder of Spark columns that an engine may replace.

A builder takes (columns, kinds, detail) and returns a Column. ``declare`` makes a new operation; ``Registry.also``
teaches or overrides one for an engine. An operation without a builder is refused by name when a query is compiled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.kinds import Kind
from sparkloom.refusal import Refusal

Builder = Callable[[list[Column], list[Kind], object], Column]


@dataclass(frozen=True, eq=False)
class Operation:
    """Compared by identity: two operations of one name are two operations."""

    name: str
    builder: Builder | None = field(default=None, repr=False)
    aggregate: bool = False
    #: What is done to an aggregate's result, after it is taken over a group or a window.
    finish: Callable[[Column, object], Column] | None = field(default=None, repr=False)


def declare(name: str, builder: Builder | None = None, aggregate: bool = False, finish: Callable[[Column, object], Column] | None = None) -> Operation:
    return Operation(name, builder, aggregate, finish)


class Registry:
    def __init__(self, taught: dict[Operation, Builder] | None = None, engine: str = "spark"):
        self.taught, self.engine = dict(taught or {}), engine

    def also(self, taught: dict[Operation, Builder]) -> Registry:
        return Registry({**self.taught, **taught}, self.engine)

    def builder(self, op: Operation) -> Builder | None:
        return self.taught.get(op, op.builder)

    def build(self, op: Operation, args: list[Column], kinds: list[Kind], detail: object = None) -> Column:
        make = self.builder(op)
        if make is None:
            raise Refusal(f"{self.engine} has no answer for the operation {op.name}")
        return make(args, kinds, detail)


def _arity(name: str, args: list[Column], n: int) -> None:
    if len(args) != n:
        raise Refusal(f"{name} takes {n} terms and got {len(args)}")


def function(name: str, n: int | None = None) -> Builder:
    """A server function by name."""

    def build(args, kinds, detail):
        if n is not None:
            _arity(name, args, n)
        return F.call_function(name, *args)

    return build


def infix(name: str, apply: Callable[[Column, Column], Column]) -> Builder:
    def build(args, kinds, detail):
        _arity(name, args, 2)
        return apply(*args)

    return build


def postfix(name: str, apply: Callable[[Column], Column]) -> Builder:
    def build(args, kinds, detail):
        _arity(name, args, 1)
        return apply(args[0])

    return build


def flip(builder: Builder) -> Builder:
    """The same with its first two terms exchanged."""
    return lambda args, kinds, detail: builder([args[1], args[0], *args[2:]], [kinds[1], kinds[0], *kinds[2:]], detail)


def fold(apply: Callable[[Column, Column], Column]) -> Builder:
    def build(args, kinds, detail):
        out = args[0]
        for a in args[1:]:
            out = apply(out, a)
        return out

    return build


def _divide(args, kinds, detail):
    _arity("division", args, 2)
    # two wholes divide to a whole, cut toward zero; Spark's own / would give a double
    return F.call_function("div", *args) if all(k is Kind.WHOLE for k in kinds) else args[0] / args[1]


def _one_of(args, kinds, detail):
    return args[0].isin(*args[1:]) if len(args) > 1 else F.lit(False)


def _string_agg(args, kinds, detail):
    _arity("string aggregation", args, 2)
    return F.collect_list(args[0])


def _joined(c: Column, detail: object) -> Column:
    """In order of the values, so that the result doesn't depend on the plan. Nulls were skipped; of none there is no text."""
    return F.when(F.size(c) > 0, F.array_join(F.array_sort(c), str(detail)))


def _seconds(args, kinds, detail):
    _arity("seconds between", args, 2)
    later, earlier = args
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


EQUAL_TO = declare("equal to", infix("=", lambda a, b: a == b))
UNEQUAL_TO = declare("unequal to", infix("<>", lambda a, b: a != b))
LESS_THAN = declare("less than", infix("<", lambda a, b: a < b))
NO_MORE_THAN = declare("no more than", infix("<=", lambda a, b: a <= b))
GREATER_THAN = declare("greater than", infix(">", lambda a, b: a > b))
NO_LESS_THAN = declare("no less than", infix(">=", lambda a, b: a >= b))
ONE_OF = declare("one of", _one_of)
ONE_OF_QUERY = declare("one of a query")
EXISTENCE = declare("existence")
SOME_VALUE = declare("some value", postfix("is not null", Column.isNotNull))
NO_VALUE = declare("no value", postfix("is null", Column.isNull))
PATTERN_MATCH = declare("pattern match", function("like", 2))
EXPRESSION_MATCH = declare("expression match", infix("rlike", lambda a, b: F.rlike(a, b)))

CONCATENATION = declare("concatenation", lambda args, kinds, detail: F.concat(*args))
SUBSTRING_OF = declare("substring", lambda args, kinds, detail: F.substring(*args))
LOWER_CASE = declare("lower case", postfix("lower", F.lower))
UPPER_CASE = declare("upper case", postfix("upper", F.upper))
WHITESPACE_TRIM = declare("trim", postfix("trim", F.trim))
CHARACTER_COUNT = declare("character count", postfix("char_length", F.char_length))
COALESCENCE = declare("coalescence", lambda args, kinds, detail: F.coalesce(*args))
SECONDS_BETWEEN = declare("seconds between", _seconds)

ADDITION = declare("addition", infix("+", lambda a, b: a + b))
SUBTRACTION = declare("subtraction", infix("-", lambda a, b: a - b))
MULTIPLICATION = declare("multiplication", infix("*", lambda a, b: a * b))
DIVISION = declare("division", _divide)

ROW_COUNT = declare("row count", lambda args, kinds, detail: F.count(F.lit(1)), aggregate=True)
VALUE_COUNT = declare("value count", postfix("count", F.count), aggregate=True)
MAXIMUM = declare("maximum", postfix("max", F.max), aggregate=True)
MINIMUM = declare("minimum", postfix("min", F.min), aggregate=True)
SUMMATION = declare("summation", postfix("sum", F.sum), aggregate=True)
WHOLE_TOTAL = declare("whole total", postfix("sum", F.sum), aggregate=True, finish=lambda c, detail: c.cast("bigint"))
AVERAGE = declare("average", postfix("avg", F.avg), aggregate=True, finish=lambda c, detail: c.cast("double"))
STRING_AGGREGATION = declare("string aggregation", _string_agg, aggregate=True, finish=_joined)
OVER_WINDOW = declare("over a window", lambda args, kinds, detail: args[0].over(detail))

CONJUNCTION = declare("conjunction", fold(lambda a, b: a & b))
DISJUNCTION = declare("disjunction", fold(lambda a, b: a | b))
NEGATION = declare("negation", postfix("not", lambda a: ~a))
BRACKET = declare("bracket", postfix("()", lambda a: a))
NULLS_FIRST_ORDER = declare("nulls first", lambda args, kinds, detail: args[0].desc_nulls_first() if detail else args[0].asc_nulls_first())
NULLS_LAST_ORDER = declare("nulls last", lambda args, kinds, detail: args[0].desc_nulls_last() if detail else args[0].asc_nulls_last())
