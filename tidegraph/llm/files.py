"""Files in the shared folder, by URI, from the driver and from executors alike."""

from __future__ import annotations

import uuid

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    store, path = filesystem(uri)
    store.create_dir(path, recursive=True)


def put(uri: str, data: bytes) -> None:
    store, path = filesystem(uri)
    with store.open_output_stream(path) as out:
        out.write(data)


def get(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def attempt_name(part: int, suffix: str) -> str:
    """A name no other attempt of the task uses; only names in a manifest count."""
    return f"{part:06d}-{uuid.uuid4().hex}{suffix}"
