"""Scalar and aggregate functions over expressions."""

from __future__ import annotations

from sparkloom.kinds import Kind
from sparkloom.operators import operations as op
from sparkloom.operators.expr import Apply, Expr, Refused, apply, same_kind, term


def count() -> Apply:
    return apply(op.ROW_COUNT, kind=Kind.WHOLE)


def count_of(e: Expr) -> Apply:
    return apply(op.VALUE_COUNT, e, kind=Kind.WHOLE)


def max_(e: Expr) -> Apply:
    return apply(op.MAXIMUM, e, kind=e.kind)


def min_(e: Expr) -> Apply:
    return apply(op.MINIMUM, e, kind=e.kind)


def sum_(e: Expr) -> Apply:
    """Wholes sum to a 64-bit whole, numbers to a number."""
    return apply(op.WHOLE_TOTAL, e, kind=Kind.WHOLE) if e.kind is Kind.WHOLE else apply(op.SUMMATION, e, kind=e.kind)


def avg(e: Expr) -> Apply:
    return apply(op.AVERAGE, e, kind=Kind.NUMBER)


def string_agg(e: Expr, separator: str) -> Apply:
    return apply(op.STRING_AGGREGATION, e, separator, kind=Kind.TEXT, detail=separator)


def _texts(what: str, *args: Expr) -> Expr | None:
    wrong = [a.kind.value for a in args if not a.kind.admits(Kind.TEXT)]
    return Refused((f"{what} takes text, not {', '.join(wrong)}",)) if wrong else None


def concat(*args: object) -> Expr:
    terms = [term(a) for a in args]
    return _texts("concat", *terms) or apply(op.CONCATENATION, *terms, kind=Kind.TEXT)


def substring(s: Expr, start: object, n: object) -> Expr:
    """``n`` characters from the 1-based ``start``."""
    return _texts("substring", s) or apply(op.SUBSTRING_OF, s, start, n, kind=Kind.TEXT)


def lower(s: Expr) -> Expr:
    return _texts("lower", s) or apply(op.LOWER_CASE, s, kind=Kind.TEXT)


def upper(s: Expr) -> Expr:
    return _texts("upper", s) or apply(op.UPPER_CASE, s, kind=Kind.TEXT)


def trim(s: Expr) -> Expr:
    return _texts("trim", s) or apply(op.WHITESPACE_TRIM, s, kind=Kind.TEXT)


def length(s: Expr) -> Expr:
    """Characters, not bytes."""
    return _texts("length", s) or apply(op.CHARACTER_COUNT, s, kind=Kind.WHOLE)


def coalesce(*args: object) -> Expr:
    terms = [term(a) for a in args]
    known = next((t.kind for t in terms if t.kind is not Kind.UNKNOWN), Kind.UNKNOWN)
    return same_kind("coalesce", known, *terms) or apply(op.COALESCENCE, *terms, kind=known)


def _arithmetic(operation: op.Operation, a: object, b: object) -> Expr:
    x, y = term(a), term(b)
    return same_kind(operation.name, x.kind, x, y) or apply(operation, x, y, kind=x.kind if x.kind is not Kind.UNKNOWN else y.kind)


def plus(a: object, b: object) -> Expr:
    return _arithmetic(op.ADDITION, a, b)


def minus(a: object, b: object) -> Expr:
    return _arithmetic(op.SUBTRACTION, a, b)


def times(a: object, b: object) -> Expr:
    return _arithmetic(op.MULTIPLICATION, a, b)


def div(a: object, b: object) -> Expr:
    """Two wholes give a whole, cut toward zero."""
    return _arithmetic(op.DIVISION, a, b)


def seconds(later: Expr, earlier: Expr) -> Expr:
    """Seconds between two moments, with fractions."""
    wrong = [x.kind.value for x in (later, earlier) if not x.kind.admits(Kind.MOMENT)]
    return Refused((f"seconds takes moments, not {', '.join(wrong)}",)) if wrong else apply(op.SECONDS_BETWEEN, later, earlier, kind=Kind.NUMBER)
