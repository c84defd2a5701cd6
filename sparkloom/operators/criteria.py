"""Criteria: boolean expressions, the algebra of unsaid ones, and keyset positions.

A criterion that says nothing (``every_row``) is left out of clauses. ``and_`` says nothing if all its members do;
``or_`` if any does; ``or_()`` and the negation of an unsaid criterion hold for no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from sparkloom.kinds import Kind
from sparkloom.operators import operations as op
from sparkloom.operators.expr import Apply, Col, Expr, Nulls, Ordering, Refused, Sub, Unsaid, Val, apply, same_kind, term


def every_row() -> Expr:
    return Unsaid()


def no_row() -> Expr:
    return Val(False, Kind.TRUTH)


def _compare(operation: op.Operation, a: object, b: object) -> Expr:
    x, y = term(a), term(b)
    return same_kind(operation.name, Kind.TRUTH, x, y) or apply(operation, x, y, kind=Kind.TRUTH)


def equal(a: object, b: object) -> Expr:
    return _compare(op.EQUAL_TO, a, b)


def not_equal(a: object, b: object) -> Expr:
    return _compare(op.UNEQUAL_TO, a, b)


def below(a: object, b: object) -> Expr:
    return _compare(op.LESS_THAN, a, b)


def at_most(a: object, b: object) -> Expr:
    return _compare(op.NO_MORE_THAN, a, b)


def above(a: object, b: object) -> Expr:
    return _compare(op.GREATER_THAN, a, b)


def at_least(a: object, b: object) -> Expr:
    return _compare(op.NO_LESS_THAN, a, b)


def column_equals(name: str, value: object) -> Expr:
    """An unqualified column and a value."""
    return equal(Col(name), value)


def in_(e: Expr, terms: Sequence[object]) -> Expr:
    """One of the terms; of none, no row."""
    terms = [term(t) for t in terms]
    if not terms:
        return no_row()
    for t in terms:
        if wrong := same_kind("one of", Kind.TRUTH, e, t):
            return wrong
    return apply(op.ONE_OF, e, *terms, kind=Kind.TRUTH)


def in_values(e: Expr, values: Iterable[object]) -> Expr:
    return in_(e, list(values))


def in_query(e: Expr, query: object) -> Expr:
    """Membership in the query's first column."""
    return Apply(op.ONE_OF_QUERY, (e, Sub(query)), Kind.TRUTH)


def exists(query: object) -> Expr:
    return Apply(op.EXISTENCE, (Sub(query),), Kind.TRUTH)


def is_null(e: Expr) -> Expr:
    return apply(op.NO_VALUE, e, kind=Kind.TRUTH)


def is_not_null(e: Expr) -> Expr:
    return apply(op.SOME_VALUE, e, kind=Kind.TRUTH)


def _on_text(operation: op.Operation, e: Expr, pattern: object) -> Expr:
    if not e.kind.admits(Kind.TEXT):
        return Refused((f"{operation.name} on {e.kind.value}",))
    return apply(operation, e, pattern, kind=Kind.TRUTH)


def like(e: Expr, pattern: object) -> Expr:
    return _on_text(op.PATTERN_MATCH, e, pattern)


def regexp(e: Expr, pattern: object) -> Expr:
    """Unanchored, Java's syntax."""
    return _on_text(op.EXPRESSION_MATCH, e, pattern)


def and_(*members: Expr) -> Expr:
    said = [m for m in members if not m.unsaid]
    return Unsaid() if not said else said[0] if len(said) == 1 else Apply(op.CONJUNCTION, tuple(said), Kind.TRUTH)


def or_(*members: Expr) -> Expr:
    if not members:
        return no_row()
    if any(m.unsaid for m in members):
        return Unsaid()
    return members[0] if len(members) == 1 else Apply(op.DISJUNCTION, tuple(members), Kind.TRUTH)


def not_(member: Expr) -> Expr:
    return no_row() if member.unsaid else Apply(op.NEGATION, (member,), Kind.TRUTH)


def bracket(member: Expr) -> Expr:
    return member if member.unsaid else Apply(op.BRACKET, (member,), Kind.TRUTH)


def at_position(order: Ordering, value: object) -> Expr:
    """On the position: equal, or null where the position is null."""
    return is_null(order.expr) if value is None else equal(order.expr, value)


def beyond(order: Ordering, value: object) -> Expr:
    """Further along the order than the value, nulls at their stated end."""
    if value is None:
        if order.nulls is Nulls.UNSTATED:
            return Refused(("a position is null, and the order doesn't say where nulls stand",))
        return is_not_null(order.expr) if order.nulls is Nulls.FIRST else no_row()
    further = below(order.expr, value) if order.descending else above(order.expr, value)
    return or_(further, is_null(order.expr)) if order.nulls is Nulls.LAST else further


def after(orders: Sequence[Ordering], values: Sequence[object]) -> Expr:
    """Keyset: rows behind the position given by values of the leading orderings. No value, every row."""
    steps, level = [], []
    for order, value in zip(orders, values, strict=False):
        steps.append(and_(*level, beyond(order, value)))
        level.append(at_position(order, value))
    return or_(*steps) if steps else every_row()
