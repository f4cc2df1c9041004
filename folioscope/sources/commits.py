"""A table that streams append to batch by batch, each batch once.

A batch is a folder of its own, named by the stream and its number; writing it again replaces it.
Spark puts ``_SUCCESS`` into a folder after the last of its files, so a folder with it is a
committed batch and the only kind that readers see; a batch that was cut off half-way is no part of
the table, and the stream's next start writes it anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _folders(spark: SparkSession, out: str) -> list[str]:
    """Committed batches, from a listing of the folders (not of their files)."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/stream=*/batch=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(str(x.getPath().getParent().toString()) for x in found or [])


def committed(spark: SparkSession, out: str, schema, but: str | None = None) -> DataFrame:
    """The table's rows; without those of the batch ``but`` (as ``batch_folder`` names it)."""
    folders = [f for f in _folders(spark, out) if but is None or not f.endswith(but)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def batch_folder(stream: str, batch: int) -> str:
    return f"/stream={stream}/batch={batch}"


def put(rows: DataFrame, out: str, stream: str, batch: int) -> None:
    """Write a batch; one of the same stream and number is replaced."""
    rows.write.mode("overwrite").parquet(f"{out}{batch_folder(stream, batch)}")
