"""Page cursors: opaque texts that hold a position and the listing, sort and filter they belong to."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
from collections.abc import Sequence

from sparkloom.refusal import PageCursorError


def fingerprint(identity: object) -> str:
    """A short text that changes with what a spec says."""
    return hashlib.blake2b(repr(identity).encode(), digest_size=9).hexdigest()


def _pack(v: object) -> list:
    if v is None:
        return ["z"]
    if isinstance(v, bool):
        return ["b", v]
    if isinstance(v, int):
        return ["i", str(v)]
    if isinstance(v, float):
        return ["n", v.hex()]
    if isinstance(v, str):
        return ["t", v]
    if isinstance(v, (bytes, bytearray)):
        return ["x", bytes(v).hex()]
    if isinstance(v, dt.datetime):
        return ["m", v.isoformat()]
    raise PageCursorError(f"a position cannot hold a {type(v).__name__}")


_UNPACK = {"z": lambda: None, "b": bool, "i": int, "n": float.fromhex, "t": str, "x": bytes.fromhex, "m": dt.datetime.fromisoformat}


def encode(tag: str, values: Sequence[object]) -> str:
    raw = json.dumps([tag, *map(_pack, values)], ensure_ascii=False, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode(cursor: str, tag: str, n: int) -> list[object]:
    """The position's values; refused if the cursor is damaged or was made for something else."""
    try:
        found, *parts = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
        values = [_UNPACK[kind](*rest) for kind, *rest in parts]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise PageCursorError("the cursor cannot be read") from e
    if found != tag:
        raise PageCursorError("the cursor belongs to another listing, sort or filter")
    if len(values) != n:
        raise PageCursorError(f"the cursor holds {len(values)} values where the order has {n}")
    return values
