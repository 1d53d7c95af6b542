"""Files in the shared store, opened from inside tasks by any scheme that pyarrow knows; a path without one is local."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from tidewire.llm.common import shared_dir


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/tidewire/{uuid.uuid4().hex}"


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it."""
    path = re.sub(r"^file:/+", "file:///", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def mapped(path: str) -> pa.NativeFile:
    """A file for random access: mapped into memory where the store is a mounted folder, else opened through its file system."""
    fs, inner = located(path)
    return pa.memory_map(inner) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(inner)
