"""Writing and reading files of the shared folder from tasks, by any URI that Arrow's file systems know."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class TaskFile:
    """A file that appears under its final name only when complete, so that a task can be run again after a loss.

    The name holds the number of the task's partition; a second attempt replaces the first one's file."""

    def __init__(self, folder: str, suffix: str):
        self.fs, path = open_fs(folder)
        self.fs.create_dir(path, recursive=True)
        n = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.name = f"part-{n:010d}{suffix}"
        self.uri = f"{folder}/{self.name}"
        self._final, self._temp = f"{path}/{self.name}", f"{path}/.{self.name}-{uuid.uuid4().hex}"
        self._out = self.fs.open_output_stream(self._temp)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Returns the offset at which the data begins."""
        self._out.write(data)
        at, self.at = self.at, self.at + len(data)
        return at

    def close(self) -> str:
        self._out.close()
        self.fs.move(self._temp, self._final)
        return self.uri


class Reader:
    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self._in = fs.open_input_file(path)
        self.size = self._in.size()

    def read(self, at: int, n: int) -> bytes:
        return self._in.read_at(n, at)

    def close(self) -> None:
        self._in.close()
