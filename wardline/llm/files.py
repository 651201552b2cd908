"""Files in the shared folder, written and read inside tasks by path or URI (local, HDFS or object store)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, stem: str, suffix: str) -> str:
    """A name no other attempt of the task uses: the manifest names the files that count."""
    where, path = open_fs(folder)
    where.create_dir(path, recursive=True)
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
