"""Binary files in the shared folder, written and read on executors. Hadoop-style URIs go through pyarrow's file systems."""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def create(folder: str, stem: str, suffix: str) -> tuple[str, BinaryIO]:
    """A new file. Each attempt of a task gets a name of its own, so that a repeated task never meets a half-written file; readers know only the names that a committed table lists."""
    system, path = _at(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}")


def open_at(uri: str):
    """A file for random access: seek, read, read_at."""
    system, path = _at(uri)
    return system.open_input_file(path)


def put(uri: str, data: bytes) -> None:
    """Write a whole file under its final name in one step, so that a repeated task replaces it by the same and no reader meets half of it."""
    system, path = _at(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:12]}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def get(uri: str) -> bytes | None:
    """A whole file, None where there is none."""
    system, path = _at(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with system.open_input_file(path) as f:
        return f.read()
