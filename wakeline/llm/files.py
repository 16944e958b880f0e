"""Binary files in the cluster's shared folder, written and read by tasks through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from wakeline.session import shared_folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared one, as a URI."""
    base = shared_folder(spark)
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    return f"{base.rstrip('/')}/wakeline-{kind}/{uuid.uuid4().hex}"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    return fs.FileSystem.from_uri(folder)


class Written:
    """A file that appears under its name only when complete, so a retried or doubled task leaves one whole file."""

    def __init__(self, folder: str, name: str):
        self._fs, root = opened(folder)
        self._fs.create_dir(root, recursive=True)
        self._final, self._part = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self._out = self._fs.open_output_stream(self._part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()
        self._fs.move(self._part, self._final)
