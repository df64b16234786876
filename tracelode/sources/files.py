"""File systems by the address of a file, for what tasks open themselves."""

from __future__ import annotations

import re

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address as Spark writes it, or of a plain path, and the path within it."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")
