"""Where the byte formats keep their files: any store that Hadoop reads, or memory."""

from __future__ import annotations

from pyspark.sql import SparkSession


class HadoopFiles:
    """Files of one folder through Hadoop's file system. A file is written whole: under another name, closed, and renamed,
    so that a reader never sees half of it; that is all that syncing could add."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def list(self) -> list[str]:
        there = self._fs.exists(self._at(""))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")) if s.isFile()) if there else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self._at(name)).getLen()

    def read(self, name: str) -> bytes:
        if not self.exists(name):
            raise FileNotFoundError(f"{self.path}/{name}")
        row = self.spark.read.format("binaryFile").load(f"{self.path}/{name}").select("content").first()
        return bytes(row.content)

    def write(self, name: str, data: bytes) -> None:
        out = self._fs.create(self._at(name + ".dbtmp"), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        self.rename(name + ".dbtmp", name)

    def rename(self, old: str, new: str) -> None:
        if self.exists(new):
            self.remove(new)
        if not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{self.path}/{old} can't become {new}")

    def remove(self, name: str) -> None:
        if not self._fs.delete(self._at(name), False):
            raise FileNotFoundError(f"{self.path}/{name}")


class MemoryFiles:
    """The same in memory, for tests and short-lived stores."""

    def __init__(self):
        self.held: dict[str, bytes] = {}

    def list(self) -> list[str]:
        return sorted(self.held)

    def exists(self, name: str) -> bool:
        return name in self.held

    def size(self, name: str) -> int:
        return len(self.read(name))

    def read(self, name: str) -> bytes:
        if name not in self.held:
            raise FileNotFoundError(name)
        return self.held[name]

    def write(self, name: str, data: bytes) -> None:
        self.held[name] = bytes(data)

    def rename(self, old: str, new: str) -> None:
        self.held[new] = self.read(old)
        del self.held[old]

    def remove(self, name: str) -> None:
        self.read(name)
        del self.held[name]
