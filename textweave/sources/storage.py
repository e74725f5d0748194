"""Small files beside tables, through Hadoop's file systems, so that any path Spark reads works."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def rename(self, old: str, new: str) -> bool:
        fs, p = self._at(old)
        return fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(new))

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written aside and renamed; if the file system won't rename onto a file, that one is deleted first."""
        aside = f"{path}.{uuid.uuid4().hex}.tmp"
        fs, p = self._at(aside)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.rename(aside, path):
            self.delete(path)
            if not self.rename(aside, path):
                raise OSError(f"can't replace {path}")

    def size(self, path: str) -> int:
        """Bytes of all files at ``path``, which may hold wildcards."""
        fs, p = self._at(path)
        return sum(fs.getContentSummary(s.getPath()).getLength() for s in (fs.globStatus(p) or []))

    def _make_new(self, path: str) -> bool:
        """Make an empty file; False if it is there. Of several makers one succeeds: local files are made by the system's exclusive call, which Hadoop's local file system lacks."""
        fs, p = self._at(path)
        try:
            if fs.getScheme() == "file":
                local = p.toUri().getPath()
                os.makedirs(os.path.dirname(local), exist_ok=True)
                os.close(os.open(local, os.O_CREAT | os.O_EXCL))
            else:
                fs.create(p, False).close()
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    @contextmanager
    def locked(self, path: str, wait_s: float = 60.0) -> Iterator[None]:
        """Hold ``path`` as a lock file: whoever makes it has the lock. One left behind by a dead writer must be deleted by hand."""
        until = time.monotonic() + wait_s
        while not self._make_new(path):
            if time.monotonic() > until:
                raise TimeoutError(f"{path} is held")
            time.sleep(0.05)
        try:
            yield
        finally:
            self.delete(path)

    def read_json(self, path: str) -> dict:
        """An empty object if the file is missing or isn't a JSON object."""
        try:
            value = json.loads(self.read(path)) if self.exists(path) else {}
        except ValueError:
            return {}
        return value if isinstance(value, dict) else {}
