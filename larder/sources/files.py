"""Files of a store: local ones with links and syncs, others through Hadoop's file systems."""

from __future__ import annotations

import os
import re
import shutil
import uuid

from pyspark.sql import SparkSession

from ..options import SyncMode


def normalized(path: str) -> str:
    """One spelling for each store: real paths for local ones."""
    path = os.fspath(path)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return path.rstrip("/") if re.match(r"[a-zA-Z][\w+.-]+:", path) else os.path.realpath(path)


def opened(spark: SparkSession, path: str) -> LocalFiles | HadoopFiles:
    return HadoopFiles(spark, path) if re.match(r"[a-zA-Z][\w+.-]+:", path) else LocalFiles(path)


def sync(path: str, data_only: bool = False) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        (os.fdatasync if data_only else os.fsync)(fd)
    finally:
        os.close(fd)


class LocalFiles:
    def __init__(self, root: str):
        self.root = root

    def full(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def url(self, *parts: str) -> str:
        return "file://" + self.full(*parts)

    def make(self, folder: str) -> None:
        os.makedirs(self.full(folder), exist_ok=True)

    def names(self, folder: str) -> list[str]:
        return sorted(os.listdir(self.full(folder))) if os.path.isdir(self.full(folder)) else []

    def sizes(self, folder: str) -> dict[str, int]:
        """Of the data files in a segment's folder."""
        return {n: os.path.getsize(self.full(folder, n)) for n in self.names(folder) if n.startswith("part-")}

    def read(self, path: str) -> bytes:
        with open(self.full(path), "rb") as f:
            return f.read()

    def publish(self, path: str, data: bytes, mode: SyncMode) -> bool:
        """Creates a file with its content in one step; False if it exists."""
        tmp = self.full(os.path.dirname(path), f".{uuid.uuid4().hex}")
        try:
            with open(tmp, "xb") as f:
                f.write(data)
                f.flush()
                (os.fsync if mode == SyncMode.ALL else os.fdatasync)(f.fileno())
            try:
                os.link(tmp, self.full(path))
            except FileExistsError:
                return False
        finally:
            if os.path.exists(tmp):
                os.unlink(tmp)
        if mode != SyncMode.DATA:
            sync(os.path.dirname(self.full(path)))
        return True

    def sync_folder(self, folder: str) -> None:
        for n in self.names(folder):
            sync(self.full(folder, n))
        sync(self.full(folder))

    def delete(self, path: str) -> None:
        full = self.full(path)
        if os.path.isdir(full):
            shutil.rmtree(full, ignore_errors=True)
        elif os.path.exists(full):
            os.unlink(full)


class HadoopFiles:
    """For stores on a cluster's file system; publishing renames without overwriting, which such systems do in one step."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def url(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def make(self, folder: str) -> None:
        self.fs.mkdirs(self.path(folder))

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder)))

    def sizes(self, folder: str) -> dict[str, int]:
        if not self.fs.exists(self.path(folder)):
            return {}
        found = {x.getPath().getName(): x.getLen() for x in self.fs.listStatus(self.path(folder))}
        return {n: s for n, s in found.items() if n.startswith("part-")}

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def publish(self, path: str, data: bytes, mode: SyncMode) -> bool:
        folder = path.rpartition("/")[0]
        tmp = self.path(folder, f".{uuid.uuid4().hex}")
        stream = self.fs.create(tmp, False)
        stream.write(bytearray(data))
        stream.hsync()
        stream.close()
        if self.fs.exists(self.path(path)) or not self.fs.rename(tmp, self.path(path)):
            self.fs.delete(tmp, False)
            return False
        return True

    def sync_folder(self, folder: str) -> None:
        """Closed files are as durable as the file system makes them."""

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)
