"""Small files and folders on any file system that Spark reaches, through Hadoop's interface."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of this machine's, if that is all of the cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="lodestar-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        found = _own_dir[0]
    return found.rstrip("/")


def mounted(path: str) -> str:
    """A path, or a file: address, as one that open() takes."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} is not on a mounted file system")
    return unquote(parts.path) if parts.scheme else path


class Files:
    """Driver-side access to one root. Paths are given in full."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def make_folder(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def read(self, path: str) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Write a file and force it to disk."""
        stream = self._fs.create(self._path(path), True)
        stream.write(bytearray(data))
        stream.hsync()
        stream.close()

    def replace(self, path: str, data: bytes) -> None:
        """Replace a file by one step: a reader, or a crash, sees the old or the new one whole."""
        draft = f"{path}.tmp"
        self.write(draft, data)
        self.move_over(draft, path)

    def move_over(self, source: str, target: str) -> None:
        """Rename a file over another one, atomically where the file system can."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self._jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        options[0] = overwrite
        context.rename(context.makeQualified(self._path(source)), context.makeQualified(self._path(target)), options)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    @staticmethod
    def fresh(path: str, label: str) -> str:
        """A path below a folder that nobody else uses."""
        return f"{path}/{label}-{uuid.uuid4().hex}"
