"""Reading parts of files from within tasks."""

from __future__ import annotations

import re


def open_ranged(uri: str):
    """A seekable file of a local path or of any address that Arrow has a file system for; only the ranges
    asked for are read."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", uri)
    system, path = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
