"""Files of a store opened inside Python data sources, by path or uri (local, hdfs, s3, gcs, …)."""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    if "://" not in path and path.startswith("file:"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, pattern: str) -> Iterator[tuple[str, int]]:
    """(path in its file system, bytes) of the file itself or of all files below a folder whose name fits, by path.

    Names that start with ``_`` or ``.``, and all below folders of such names, are left out, as Spark's readers do.
    """
    store, base = at(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        yield info.path, info.size
        return
    for f in sorted(store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)), key=lambda f: f.path):
        inner = posixpath.relpath(f.path, base.rstrip("/") or "/")
        hidden = any(part[:1] in "_." for part in inner.split("/"))
        if f.type == fs.FileType.File and not hidden and fnmatch.fnmatch(f.base_name, pattern):
            yield f.path, f.size
