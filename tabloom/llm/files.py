"""Binary files in the shared folder, read and written as streams from inside tasks.

Paths are URIs; the file system is whatever their scheme names (local, HDFS, S3, ...). A file gets
its name only when it is complete, and only files named in the table that the
writing job returns count, so a repeated or lost task leaves nothing that is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@contextmanager
def writing(folder: str, suffix: str) -> Iterator[tuple[object, str]]:
    """A stream to a new file in ``folder`` and the name it has afterwards."""
    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    name = uuid.uuid4().hex + suffix
    with system.open_output_stream(f"{path}/_{name}", compression=None) as out:
        yield out, f"{folder.rstrip('/')}/{name}"
    system.move(f"{path}/_{name}", f"{path}/{name}")


def reading(uri: str, seek: bool = False):
    system, path = _place(uri)
    return system.open_input_file(path) if seek else system.open_input_stream(path, compression=None)
