"""Declared text searches: by prefix, by words, by fragment. All are native predicates, so they run where the rows are.

A text without anything to search for matches every row. Searching is by scan: Spark has no text index; Parquet's
statistics help a prefix search on a stored lower-case column (``declare_search`` may name one).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.kinds import Kind
from sparkloom.operators.expr import Apply, Expr, Refused, Unsaid
from sparkloom.operators.expr import apply as apply_
from sparkloom.operators.operations import declare
from sparkloom.plans.select import Source
from sparkloom.refusal import Refusal

_PARTS = r"[^\p{L}\p{Nd}]+"
_WORDS = re.compile(r"[^\W_]+")


class Match(Enum):
    PREFIX = "prefix"
    WORDS = "words"
    FRAGMENT = "fragment"


@dataclass(frozen=True)
class Search:
    name: str
    columns: tuple[str, ...]
    match: Match
    language: str = "simple"

    def reasons(self) -> list[str]:
        out = []
        if not self.columns:
            out.append(f"the search {self.name} has no column")
        if self.match is not Match.WORDS and len(self.columns) > 1:
            out.append(f"the {self.match.value} search {self.name} has {len(self.columns)} columns and takes one")
        if self.language != "simple":
            out.append(f"the search {self.name} wants the language {self.language}; words are not stemmed here")
        return out


def declare_search(name: str, columns: Sequence[str], match: Match, language: str = "simple") -> Search:
    return Search(name, tuple(columns), match, language)


PREFIX_MATCH = declare("prefix match", lambda args, kinds, detail: F.lower(args[0]).startswith(F.lower(args[1])))
FRAGMENT_MATCH = declare("fragment match", lambda args, kinds, detail: F.lower(args[0]).contains(F.lower(args[1])))


def _every_word(args, kinds, detail):
    words = F.split(F.lower(F.concat_ws(" ", *args)), _PARTS)
    out = F.lit(True)
    for w in detail:
        out = out & F.array_contains(words, w)
    return out


WORDS_MATCH = declare("words match", _every_word)


def words_of(text: str) -> tuple[str, ...]:
    """Lower-case runs of letters and decimal digits, each once."""
    parts = (w for run in _WORDS.findall(text.lower()) for w in re.split(r"[^\w]", "".join(c if c.isalpha() or c.isdecimal() else " " for c in run)))
    return tuple(dict.fromkeys(p for w in parts for p in w.split()))


def matches(source: Source, searches: Sequence[Search], name: str, text: str) -> Expr:
    """The criterion of a declared search over a table; refused over a query, or if it isn't declared."""
    found = next((s for s in searches if s.name == name), None)
    if found is None:
        return Refused((f"there is no search {name}",))
    if source.query is not None:
        return Refused((f"the search {name} is over a query, not a table",))
    if why := found.reasons():
        return Refused(tuple(why))
    columns = tuple(source.of(c, Kind.TEXT) for c in found.columns)
    if found.match is Match.WORDS:
        words = words_of(text)
        return Apply(WORDS_MATCH, columns, Kind.TRUTH, words) if words else Unsaid()
    if not text:
        return Unsaid()
    return apply_(PREFIX_MATCH if found.match is Match.PREFIX else FRAGMENT_MATCH, columns[0], text, kind=Kind.TRUTH)


def searchable(df: DataFrame, searches: Sequence[Search]) -> DataFrame:
    """The rows with a stored column for each search: lower-case text for prefixes and fragments, words for words.

    Written so, a prefix search on ``<name>_search`` reaches the Parquet scan, which skips files by their statistics.
    """
    for s in searches:
        if why := s.reasons():
            raise Refusal(*why)
        columns = [F.col(f"`{c}`") for c in s.columns]
        value = F.array_distinct(F.split(F.lower(F.concat_ws(" ", *columns)), _PARTS)) if s.match is Match.WORDS else F.lower(columns[0])
        df = df.withColumn(f"{s.name}_search", value)
    return df


def unsearchable(df: DataFrame, searches: Sequence[Search]) -> DataFrame:
    return df.drop(*[f"{s.name}_search" for s in searches])


def matches_stored(s: Search, text: str) -> Column:
    """The criterion of a search over the column that ``searchable`` stored."""
    stored = F.col(f"`{s.name}_search`")
    if s.match is Match.WORDS:
        out = F.lit(True)
        for w in words_of(text):
            out = out & F.array_contains(stored, w)
        return out
    return stored.startswith(text.lower()) if s.match is Match.PREFIX else stored.contains(text.lower())
