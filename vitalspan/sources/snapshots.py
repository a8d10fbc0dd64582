"""A small table that is replaced as a whole, and never half.

Every commit writes a new numbered folder. Readers take the highest number
whose write has finished; a run that dies leaves the one before in place. The
folder before the current one is kept for readers that have just planned on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalspan.session import literal_frame


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), root


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if there is no such folder."""
    files, root = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(root)) if files.exists(root) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    files, root = _files(spark, path)
    files.delete(root, True)


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _folder(self, number: int) -> str:
        return f"{self.path}/{number:09d}"

    def numbers(self) -> list[int]:
        """Finished snapshots, oldest first."""
        names = [n for n in folder_names(self.spark, self.path) if n.isdigit()]
        return [int(n) for n in names if "_SUCCESS" in folder_names(self.spark, f"{self.path}/{n}")]

    def current(self) -> int:
        return max(self.numbers(), default=0)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a snapshot, by default the newest; none before the first."""
        number = self.current() if number is None else number
        if not number:
            return literal_frame(self.spark, [], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(number))

    def commit(self, rows: DataFrame, after: int) -> int:
        """Writes the successor of snapshot ``after``. If another writer has
        finished that number, it fails and changes nothing; an unfinished
        folder of a run that died is replaced."""
        number = after + 1
        if number in self.numbers():
            raise RuntimeError(f"snapshot {number} of {self.path} was written by another run")
        rows.coalesce(1).write.mode("overwrite").parquet(self._folder(number))
        for old in self.numbers():
            if old < after:
                delete_folder(self.spark, self._folder(old))
        return number
