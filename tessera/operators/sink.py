"""Named text files: one UTF-8 file per row, at a path that the row gives.

A file appears whole or not at all, also if a task is retried or runs twice: local
files are written under a name of their own and renamed, object stores show a file when
it is closed. Files of earlier runs are overwritten or left as they are.

The folder is a local path, which the driver and all executors must share, or a URI
that Arrow's file systems open on every executor (``file``, ``hdfs``, ``s3``, ``gs``;
``s3a`` is ``s3``).
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row


def safe_target(folder: str, rel_path: str) -> Path:
    """The file at ``rel_path`` below ``folder``; a path that leads out is refused."""
    root = Path(folder).resolve()
    target = (root / rel_path).resolve()
    if root not in target.parents:
        raise ValueError(f"path leads out of the output folder: {rel_path}")
    return target


def write_text(target: Path, text: str) -> None:
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{uuid.uuid4().hex}.part")
    part.write_bytes(text.encode())
    os.replace(part, target)


def _is_uri(folder: str) -> bool:
    return "://" in folder or folder.startswith("file:")


class Store:
    """A folder of one of Arrow's file systems."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        scheme, _, rest = folder.partition(":")
        self.system, root = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{rest if rest.startswith('//') else '//' + rest}")
        self.root = root.rstrip("/")
        self.local = isinstance(self.system, fs.LocalFileSystem)

    def write(self, rel_path: str, text: str) -> None:
        if self.local:  # with its check of links, and a rename
            write_text(safe_target(self.root, rel_path), text)
            return
        target = posixpath.normpath(posixpath.join(self.root, rel_path))
        if not target.startswith(f"{self.root}/"):
            raise ValueError(f"path leads out of the output folder: {rel_path}")
        self.system.create_dir(posixpath.dirname(target), recursive=True)
        with self.system.open_output_stream(target) as out:
            out.write(text.encode())


def make_folder(folder: str) -> None:
    if not _is_uri(folder):
        Path(folder).mkdir(parents=True, exist_ok=True)
    else:
        store = Store(folder)
        store.system.create_dir(store.root, recursive=True)


def write_files(rows: DataFrame, folder: str) -> None:
    """Write ``rows(rel_path, text)`` below ``folder``, which is made first."""
    make_folder(folder)

    def write(part: Iterator[Row]) -> None:
        store = Store(folder) if _is_uri(folder) else None
        for r in part:
            if store:
                store.write(r["rel_path"], r["text"])
            else:
                write_text(safe_target(folder, r["rel_path"]), r["text"])

    rows.select("rel_path", "text").foreachPartition(write)
