"""File systems for functions that read and write files in tasks."""

from __future__ import annotations

import re


def open_store(path: str):
    """(file system, path in it) of a URI or a plain path, through pyarrow, so that any store it knows works."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
