"""Written tables in the folder that all executors share, and the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch: shuffle files of a finished SQL execution go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the cluster's shared folder. Where none is set, one under the warehouse
    if all runs on this machine, else an error: a local folder is no place that executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/folioscope-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # nothing but the table is read again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut of lineage
    that outlives executors. Partitions are as Spark makes them."""
    return _write(df, f"{shared_dir(df.sparkSession)}/{name}")


class Scratch:
    """The written tables of one run in one folder; each can go once nothing reads it again."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, shared_dir(spark), 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        out = _write(df, path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that ``put`` has returned; others are left alone."""
        for t in tables:
            path = self.paths.pop(id(t), None)
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
