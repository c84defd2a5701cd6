"""Binary files in the shared folder, by URI: local paths and ``file:`` directly, anything else through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def make_dir(uri: str) -> None:
    if (path := _local(uri)) is not None:
        os.makedirs(path, exist_ok=True)
    else:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(path, recursive=True)


def open_out(uri: str):
    if (path := _local(uri)) is not None:
        return open(path, "wb")
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_output_stream(path)


def open_in(uri: str):
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def put(uri: str, data: bytes) -> None:
    """A whole file at once, under its name only when it is complete; writing the same again does no harm."""
    part = f"{uri}.{uuid.uuid4().hex}"
    with open_out(part) as f:
        f.write(data)
    if (path := _local(uri)) is not None:
        os.replace(_local(part), path)
    else:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(part)
        where.move(path, path[: path.rindex(".")])
