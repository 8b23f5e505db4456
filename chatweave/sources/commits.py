"""Tables whose batches become visible together.

A batch writes several tables (messages, marks, vectors). Each attempt writes
to folders of its own, ``<table>/batch_id=<n>/attempt=<id>``, and one row in
``commits`` names the attempt once all of them are there; it is a single file,
which Spark's committer renames into place. Readers take the newest committed
attempt of each batch and see no other folder: neither a batch that broke off
between two tables, nor half of a repeated one. Running a batch again adds an
attempt and a commit; what readers see is never overwritten or removed, until
``vacuum`` is asked to remove what no commit names any more.

One writer per batch at a time; the list of commits has a row per batch.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chatweave.session import remove_path

COMMITS = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.StringType()), T.StructField("number", T.LongType())])


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


@dataclass(frozen=True)
class CommittedTables:
    spark: SparkSession
    root: str

    def begin(self) -> str:
        """A new attempt."""
        return uuid.uuid4().hex

    def write(self, name: str, df: DataFrame, batch_id: int, attempt: str, sort_cols: tuple[str, ...] = ()) -> None:
        out = df.drop("batch_id")
        if sort_cols:
            out = out.sortWithinPartitions(*sort_cols)
        out.write.mode("errorifexists").parquet(f"{self.root}/{name}/batch_id={int(batch_id)}/attempt={attempt}")

    def commit(self, batch_id: int, attempt: str) -> None:
        """Make all that ``attempt`` wrote the batch's visible content."""
        number = 1 + max([n for b, _, n in self._rows() if b == int(batch_id)], default=0)
        row = self.spark.createDataFrame([(int(batch_id), attempt, number)], COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def _rows(self) -> list[tuple[int, str, int]]:
        if not _exists(self.spark, f"{self.root}/commits"):
            return []
        return [tuple(r) for r in self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits").collect()]

    def visible(self, before_batch: int | None = None) -> dict[int, str]:
        """Batch -> attempt."""
        newest: dict[int, tuple[int, str]] = {}
        for batch, attempt, number in self._rows():
            if (before_batch is None or batch < before_batch) and number > newest.get(batch, (0, ""))[0]:
                newest[batch] = (number, attempt)
        return {b: a for b, (_, a) in sorted(newest.items())}

    def read(self, name: str, schema: T.StructType, before_batch: int | None = None) -> DataFrame:
        """The visible rows of a table, with ``batch_id``. ``schema`` is that of
        its batches; a batch without rows or without this table gives none."""
        full = T.StructType([f for f in schema.fields if f.name != "batch_id"]).add("batch_id", T.LongType())
        paths = [f"{self.root}/{name}/batch_id={b}/attempt={a}" for b, a in self.visible(before_batch).items()]
        paths = [p for p in paths if _exists(self.spark, p)]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(*paths).select(*full.names)

    def vacuum(self, names: list[str]) -> list[str]:
        """Remove the attempts that no commit makes visible. Not to be called
        while a batch is being written or an old one read."""
        keep, gone = self.visible(), []
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            found = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/batch_id=*/attempt=*")
            for status in found.getFileSystem(conf).globStatus(found) or []:
                path = status.getPath().toString()
                batch, attempt = path.split("/batch_id=")[1].split("/attempt=")
                if keep.get(int(batch)) != attempt:
                    remove_path(self.spark, path)
                    gone.append(path)
        return gone


def committed_or_none(tables: CommittedTables, name: str, schema: T.StructType, before_batch: int) -> DataFrame | None:
    """``read``, or None if no earlier batch is visible."""
    return tables.read(name, schema, before_batch) if tables.visible(before_batch) else None

