"""What can go wrong, as types. A Refusal is raised before Spark is asked for anything."""

from __future__ import annotations


class Refusal(ValueError):
    """A query that cannot be run, with every reason found."""

    def __init__(self, *reasons: str):
        self.reasons = tuple(dict.fromkeys(reasons))
        super().__init__("; ".join(self.reasons))


class Fault(RuntimeError):
    """Something failed while data was read or written."""


class NoRows(Fault):
    """One row was asked for; there is none."""


class SeveralRows(Fault):
    """One row was asked for; there are several."""


class AlreadyThere(Fault):
    """A unique key is taken."""


class BrokenRule(Fault):
    """A check, a required column or a reference does not hold."""


class NotInCollection(Fault):
    """The element, or the neighbour it is placed by, is not in the collection."""


class Conflict(Fault):
    """Another transaction committed first."""


class PageQueryError(ValueError):
    """A page request that the listing does not allow."""


class PageCursorError(PageQueryError):
    """A cursor that is damaged or belongs to another listing, sort or filter."""


class Irreversible(Fault):
    """A change that states no way back."""
