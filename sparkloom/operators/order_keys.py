"""Fractional order keys: texts between any two others, in byte order.

A key is the digits of a fraction in base 62, most significant first, without a trailing "0" (so that there is always
room before it). A key of more than ``LONGEST`` digits is a sign to spread the collection's keys anew.
"""

from __future__ import annotations

from sparkloom.refusal import Refusal

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE = len(DIGITS)
LONGEST = 32
_VALUE = {d: i for i, d in enumerate(DIGITS)}


def _value(key: str, places: int) -> int:
    """The key's fraction in units of the last of ``places`` digits."""
    if any(c not in _VALUE for c in key) or key.endswith("0"):
        raise Refusal(f"{key!r} is no order key")
    out = 0
    for c in key.ljust(places, "0"):
        out = out * BASE + _VALUE[c]
    return out


def _key(value: int, places: int) -> str:
    out = []
    for _ in range(places):
        value, d = divmod(value, BASE)
        out.append(DIGITS[d])
    return "".join(reversed(out)).rstrip("0")


def key_between(low: str | None, high: str | None) -> str:
    """A key between two others; None is the open end.

    Beside an open end it is the next place of the key's own length, or of one digit more, so that long runs of appending
    grow keys slowly; between two keys it is the shortest key that halves the room best.
    """
    if low is not None and high is not None and low >= high:
        raise Refusal(f"{low!r} is not before {high!r}")
    if (low is None) != (high is None):
        end, step = (low, 1) if high is None else (high, -1)
        for places in (len(end), len(end) + 1):
            beside = _value(end, places) + step
            if 0 < beside < BASE**places:
                return _key(beside, places)
    places = 1
    while True:
        # both ends in units of the last place; a longer end is cut, and the low one then rounded up to stay behind it
        scale = max(places, len(low or ""), len(high or ""))
        unit = BASE ** (scale - places)
        bottom = 0 if low is None else _value(low, scale)
        top = BASE**scale if high is None else _value(high, scale)
        first, last = bottom // unit + 1, -(-top // unit) - 1
        if first <= last:
            return _key((first + last) // 2, places)
        places += 1


def even_keys(n: int) -> list[str]:
    """``n`` keys, evenly spread, in order."""
    places = 1
    while BASE**places <= 2 * n:
        places += 1
    step = BASE**places / (n + 1)
    out, last = [], 0
    for i in range(n):
        last = max(last + 1, round(step * (i + 1)))
        out.append(_key(last, places))
    return out


def too_long(key: str) -> bool:
    return len(key) > LONGEST
