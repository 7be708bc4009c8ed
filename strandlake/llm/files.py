"""Files that tasks write to and read from a shared folder of any file system pyarrow knows."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark import TaskContext


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a plain absolute path."""
    return pafs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name that no other attempt of this task, or other task, uses.

    Tasks may run twice, so a table of written files must be taken from the attempts that Spark committed; files of
    the others are never read.
    """
    t = TaskContext.get()
    part, attempt = (t.partitionId(), t.taskAttemptId()) if t else (0, 0)
    return f"{prefix}-{part:06d}-{attempt}-{uuid.uuid4().hex[:8]}{suffix}"


def make_folder(uri: str) -> None:
    fs, path = locate(uri)
    fs.create_dir(path, recursive=True)
