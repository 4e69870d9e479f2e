"""Files that tasks write and read by themselves, for formats that Spark has
no writer for.

A task names each file freshly and reports it as a row; the rows are written
as a manifest table by Spark's own commit, and readers open only files that
the manifest names. A task that is lost or runs twice leaves a file that no
manifest knows. Paths are URIs below the session's shared checkpoint folder
(file:, s3:, gs:, hdfs: as pyarrow opens them).
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_filesystem(uri: str):
    """(filesystem, path) of a URI or a plain local path."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return fs.LocalFileSystem(), uri


def fresh_file(folder: str, suffix: str) -> str:
    filesystem, path = open_filesystem(folder)
    filesystem.create_dir(path, recursive=True)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def open_output(uri: str):
    """A stream that writes the bytes as they are, whatever the suffix."""
    filesystem, path = open_filesystem(uri)
    return filesystem.open_output_stream(path, compression=None)


def write_file(uri: str, chunks) -> None:
    with open_output(uri) as out:
        for c in chunks:
            out.write(c)


def open_input(uri: str):
    filesystem, path = open_filesystem(uri)
    return filesystem.open_input_file(path)
