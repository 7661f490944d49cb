"""The file system of a path, through Spark's own Hadoop client, so that any store Spark reaches will do."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where none is named, a local folder serves a session whose executors are in the
    driver's own process, as in tests; on a cluster the missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="fluxmill-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, gone when the driver ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    files = Files(spark, path)
    files.mkdirs(path)
    files.delete_on_exit(path)
    return path


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def mkdirs(self, name: str) -> None:
        self._fs.mkdirs(self.path(name))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self.path(name), True)

    def delete_on_exit(self, name: str) -> None:
        self._fs.deleteOnExit(self.path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(folder)))

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files below a folder."""
        return self._fs.getContentSummary(self.path(name)).getLength()

    def rename(self, a: str, b: str) -> bool:
        return self._fs.rename(self.path(a), self.path(b))

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet, whole or not at all; False if another writer was first.

        Exactly one of any number of writers wins.  A local file is linked to its
        final name, which fails if the name is taken; on HDFS a rename does; object
        stores are asked for a conditional put, and those that have none refuse.
        """
        target = self.path(name)
        folder = self._fs.resolvePath(target.getParent())  # through mount tables
        store = folder.getFileSystem(self._conf)
        if store.getScheme() == "file":
            folder = folder.toUri().getPath()
            draft = os.path.join(folder, f".{uuid.uuid4().hex}.tmp")
            with open(draft, "x", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(draft, os.path.join(folder, target.getName()))
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        if store.getScheme() in ("hdfs", "webhdfs"):
            draft = self._jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}.tmp")
            self._write(store.create(draft, False), text)
            if not store.rename(draft, self._jvm.org.apache.hadoop.fs.Path(folder, target.getName())):
                store.delete(draft, False)
                return False
            return True
        builder = store.createFile(self._jvm.org.apache.hadoop.fs.Path(folder, target.getName())).overwrite(False).must("fs.option.create.conditional.overwrite", True)
        try:
            self._write(builder.build(), text)
        except Exception as e:
            if "exist" in str(e).lower() or "412" in str(e):
                return False
            raise
        return True

    @staticmethod
    def _write(stream, text: str) -> None:
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def read_json(self, name: str):
        return json.loads(self.read(name))
