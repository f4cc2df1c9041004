"""Written tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, one under the warehouse if all
    runs on this machine, else an error: a local folder is no place that executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's own switch: shuffle files of a finished SQL execution go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that what is read several times is
    computed once and outlives executors. Its shuffle files go, as nothing reads them again."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "cut")
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has returned and that nothing reads again."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()[:1]}:
            if "/cut-" in path:
                where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
