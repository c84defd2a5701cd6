"""Kinds: what a query knows about a column before Spark analyses it."""

from __future__ import annotations

import datetime as dt
from enum import Enum

from pyspark.sql import types as T


class Kind(Enum):
    TEXT = "text"
    WHOLE = "whole"
    NUMBER = "number"
    TRUTH = "truth"
    BYTES = "bytes"
    MOMENT = "moment"
    DOCUMENT = "document"
    UNKNOWN = "unknown"

    def admits(self, other: Kind) -> bool:
        """Unknown on either side admits everything; otherwise both must be equal (a whole is no number)."""
        return self is other or Kind.UNKNOWN in (self, other)


_BY_TYPE = {
    T.StringType: Kind.TEXT,
    T.VarcharType: Kind.TEXT,
    T.CharType: Kind.TEXT,
    T.ByteType: Kind.WHOLE,
    T.ShortType: Kind.WHOLE,
    T.IntegerType: Kind.WHOLE,
    T.LongType: Kind.WHOLE,
    T.FloatType: Kind.NUMBER,
    T.DoubleType: Kind.NUMBER,
    T.BooleanType: Kind.TRUTH,
    T.BinaryType: Kind.BYTES,
    T.TimestampType: Kind.MOMENT,
    T.TimestampNTZType: Kind.MOMENT,
    T.StructType: Kind.DOCUMENT,
    T.ArrayType: Kind.DOCUMENT,
    T.MapType: Kind.DOCUMENT,
}


def kind_of(data_type: T.DataType) -> Kind:
    """The kind of a Spark type; types without one (decimal, date, interval) are unknown and so unchecked."""
    return _BY_TYPE.get(type(data_type), Kind.UNKNOWN)


def kind_of_value(value: object) -> Kind | None:
    """The kind that binds a Python value; UNKNOWN for None, nothing for a value that cannot be bound."""
    if value is None:
        return Kind.UNKNOWN
    for kinds, kind in (((bool,), Kind.TRUTH), ((int,), Kind.WHOLE), ((float,), Kind.NUMBER), ((str,), Kind.TEXT), ((bytes, bytearray), Kind.BYTES), ((dt.datetime,), Kind.MOMENT)):
        if isinstance(value, kinds):
            return kind
    return None
