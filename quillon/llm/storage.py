"""Files that executors write to and read from the shared folder, through pyarrow's file systems."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def open_fs(uri: str):
    """File system and path of a URI; a bare path is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@contextlib.contextmanager
def new_file(uri: str):
    """A writable stream that gets its name only when complete, so a lost or repeated task
    leaves no partial file; a repeated task writes the same bytes under the same name."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)


def read_file(uri: str):
    """A random-access file."""
    system, path = open_fs(uri)
    return system.open_input_file(path)


def exists(uri: str) -> bool:
    system, path = open_fs(uri)
    return system.get_file_info(path).type == fs.FileType.File
