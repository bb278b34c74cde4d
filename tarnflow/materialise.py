"""Tables written in the shared folder to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where the session has it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarnflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_open: dict[str, SparkSession] = {}


@atexit.register
def _leave() -> None:
    for path, spark in list(_open.items()):
        with contextlib.suppress(Exception):
            delete(spark, path)


class Stage:
    """A DataFrame written as Parquet in the shared folder.

    A lost executor costs no recomputation beyond the running stage, and the shuffle files behind the table
    are removed as soon as it is written.
    """

    def __init__(self, df: DataFrame, label: str, bucket: str | None = None, buckets: int = 0) -> None:
        self.spark = df.sparkSession
        name = f"tarnflow-{label}-{uuid.uuid4().hex}"
        self.path, self.table = f"{shared_dir(self.spark)}/{name}", name.replace("-", "_") if bucket else None
        _open[self.path] = self.spark
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            if bucket:
                # Joins and sums by the bucket column need no exchange of this table.
                df.repartition(buckets, bucket).write.format("parquet").bucketBy(buckets, bucket).sortBy(bucket).option("path", self.path).saveAsTable(self.table)
            else:
                df.write.parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.table) if self.table else self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; nothing may read the table afterwards."""
        if _open.pop(self.path, None):
            if self.table:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            delete(self.spark, self.path)
