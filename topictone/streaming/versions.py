"""Versioned tables in a folder, for state that a stream carries from one micro-batch to
the next: a version is a parquet folder, and it counts only when its mark is there.

The mark is written beside and renamed after the data is complete, so a reader sees
the last whole version or the one before, never a half-written one, and a
micro-batch that is repeated writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import remove_path


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """The committed versions, ascending."""
        fs, path = self._fs()
        marks = path(f"{self.path}/marks")
        if not fs.exists(marks):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(marks)]
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self, before: int | None = None) -> int | None:
        return max((v for v in self.versions() if before is None or v < before), default=None)

    def folder(self, version: int) -> str:
        return f"{self.path}/version-{version}"

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self.folder(version))

    def note(self, version: int) -> str:
        """What was committed with the version."""
        lines = self.spark.read.text(f"{self.path}/marks/{version}").collect()
        return lines[0][0] if lines else ""

    def write(self, df: DataFrame, version: int) -> DataFrame:
        """Write a version; it doesn't count before ``commit``."""
        df.write.mode("overwrite").parquet(self.folder(version))
        return self.read(version)

    def commit(self, version: int, note: str = "") -> None:
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.path}/marks"))
        new, mark = path(f"{self.path}/marks/_{version}"), path(f"{self.path}/marks/{version}")
        out = fs.create(new, True)
        try:
            out.write(bytearray(note.encode()))
        finally:
            out.close()
        if fs.exists(mark):
            fs.delete(mark, False)
        if not fs.rename(new, mark):
            raise OSError(f"could not commit version {version} of {self.path}")

    def forget(self, before: int) -> None:
        """Remove the versions below ``before``, mark first."""
        for v in self.versions():
            if v < before:
                remove_path(self.spark, f"{self.path}/marks/{v}")
                remove_path(self.spark, self.folder(v))
