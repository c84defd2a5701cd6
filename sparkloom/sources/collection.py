"""Lazy collections: elements of an owner, in an order that people make, too many to be loaded as one value.

A table of (owner, element, position), keyed by owner and element. The position is a fractional order key, so placing an
element writes one row; when a key grows too long the owner's keys are spread anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.expr import Ordering
from sparkloom.operators.listing import Listing, listing
from sparkloom.operators.order_keys import even_keys, key_between, too_long
from sparkloom.refusal import AlreadyThere, NotInCollection
from sparkloom.sources.store import Store, Transaction, rows_of, transact
from sparkloom.sources.tables import ForeignKey, Table


@dataclass(frozen=True)
class Placement:
    where: str  # first, last, before, after
    neighbour: object = None


FIRST, LAST = Placement("first"), Placement("last")


def before(element: object) -> Placement:
    return Placement("before", element)


def after(element: object) -> Placement:
    return Placement("after", element)


class Collection:
    def __init__(self, store: Store, owner: Table, name: str, element: Table, ordered: bool = True, on_delete: str = "restrict"):
        self.store, self.ordered = store, ordered
        types = {n: t for t_ in (owner, element) for n, t, _ in t_.columns}
        self.owner, self.element = f"{owner.name}_{owner.key[0]}", f"{element.name}_{element.key[0]}"
        columns = [(self.owner, dict((n, t) for n, t, _ in owner.columns)[owner.key[0]], False), (self.element, types[element.key[0]], False)]
        if ordered:
            columns.append(("position", T.StringType(), False))
        keys = (ForeignKey((self.owner,), owner.name, owner.key, "cascade"), ForeignKey((self.element,), element.name, element.key, on_delete))
        self.table = Table(f"{owner.name}_{name}", tuple(columns), (self.owner, self.element), (), keys, parent=owner.name)
        store.describes(self.table)

    def create(self) -> None:
        with self.store.transaction() as t:
            t.create(self.table)

    def _own(self, t: Transaction | Store, owner: object) -> DataFrame:
        return t.table(self.table.name).filter(F.col(self.owner) == F.lit(owner))

    def has(self, owner: object, element: object) -> bool:
        return bool(self._own(self.store, owner).filter(F.col(self.element) == F.lit(element)).limit(1).collect())

    def _key(self, t: Transaction, owner: object, element: object, place: Placement) -> str:
        others = self._own(t, owner).filter(F.col(self.element) != F.lit(element))
        if place.where in ("first", "last"):
            low, high = others.agg(F.min("position"), F.max("position")).first()
            return key_between(None, low) if place.where == "first" else key_between(high, None)
        at = others.filter(F.col(self.element) == F.lit(place.neighbour)).select("position").first()
        if at is None:
            raise NotInCollection(f"{place.neighbour} is not in the collection of {owner}")
        if place.where == "before":
            low = others.filter(F.col("position") < F.lit(at[0])).agg(F.max("position")).first()[0]
            return key_between(low, at[0])
        high = others.filter(F.col("position") > F.lit(at[0])).agg(F.min("position")).first()[0]
        return key_between(at[0], high)

    def _place(self, t: Transaction, owner: object, element: object, place: Placement) -> None:
        row = {self.owner: owner, self.element: element}
        if self.ordered:
            row["position"] = self._key(t, owner, element, place)
            if too_long(row["position"]):
                self._spread(t, owner)
                row["position"] = self._key(t, owner, element, place)
        t.upsert(self.table.name, rows_of(t, self.table.name, [row]))

    def _spread(self, t: Transaction, owner: object) -> None:
        own = [r[0] for r in self._own(t, owner).orderBy("position").select(self.element).collect()]
        rows = [{self.owner: owner, self.element: e, "position": k} for e, k in zip(own, even_keys(len(own)), strict=True)]
        t.upsert(self.table.name, rows_of(t, self.table.name, rows))

    def insert(self, owner: object, element: object, place: Placement = LAST) -> None:
        def work(t: Transaction) -> None:
            if self._own(t, owner).filter(F.col(self.element) == F.lit(element)).limit(1).collect():
                raise AlreadyThere(f"{element} is in the collection of {owner}")
            self._place(t, owner, element, place)

        transact(self.store, work)

    def move(self, owner: object, element: object, place: Placement) -> None:
        def work(t: Transaction) -> None:
            if not self._own(t, owner).filter(F.col(self.element) == F.lit(element)).limit(1).collect():
                raise NotInCollection(f"{element} is not in the collection of {owner}")
            self._place(t, owner, element, place)

        transact(self.store, work)

    def remove(self, owner: object, element: object) -> int:
        def work(t: Transaction) -> int:
            return t.delete(self.table.name, rows_of(t, self.table.name, [{self.owner: owner, self.element: element}]))

        return transact(self.store, work)

    def listing(self, owner: object) -> Listing:
        """Pages of one owner's elements: in their places, or by value."""
        from sparkloom.operators.criteria import equal

        s = self.table.source()
        out = listing(s, self.element).within(equal(s.of(self.owner), owner))
        if self.ordered:
            out = out.sort("placed", Ordering(s.of("position")))
        return out.sort("value", Ordering(s.of(self.element)))
