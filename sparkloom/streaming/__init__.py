"""Results as streams: rows are pulled from a finite result, a partition at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import DataFrame, Row

A = TypeVar("A")


def pulled(df: DataFrame, decode: Callable[[Row], A] | None = None) -> Iterator[A]:
    """Each row, decoded if asked. Partitions that are not reached are not computed."""
    for row in df.toLocalIterator():
        yield decode(row) if decode else row
