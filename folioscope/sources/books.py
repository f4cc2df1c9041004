"""Sources: text files as bytes, extracted line tables, stored results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.layout import with_index

SUPPORTED = ("txt", "pdf")
RESULT = (
    "chapters array<struct<chapter_index:int,title:string,scores:map<string,double>>>, "
    "blocks array<struct<block_index:int,chapter_index:int,scene_index:int,scene_ref:string,top:string,above:string>>"
)
TEXTS = "text_id string, user_id string, title string, filename string, content binary, format string, created_at timestamp"
RESULTS = "result_id string, text_id string, job_id string, result_json string, created_at timestamp"


def decoded(books: DataFrame, content: str = "content", fallback: str = "cp1251") -> DataFrame:
    """Bytes to text: UTF-8 if valid (built in), else the fallback encoding (helper)."""

    @F.pandas_udf("string")
    def other(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else bytes(x).decode(fallback, "replace"))

    valid = F.is_valid_utf8(F.col(content).cast("string"))
    bad = F.when(~F.coalesce(valid, F.lit(True)), F.col(content))
    return books.withColumn("text", F.coalesce(other(bad), F.col(content).cast("string")))


def read_books(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(books, rejected): files of a supported format by name; others are listed."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("book_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    kind = files.withColumn("format", T.detect_format("filename"))
    return decoded(kind.where(F.col("format").isin(*SUPPORTED))), kind.where(~F.col("format").isin(*SUPPORTED)).select("book_id", "filename", "format")


def line_table(rows: DataFrame) -> DataFrame:
    """Extracted layout lines -> a line table: clean texts, no empty ones, and global_index."""
    return with_index(rows.withColumn("text", T.clean_line("text")).where("text != ''"))


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, pages): the extracted line table, and every page it names, empty ones too, with its
    width and height."""
    rows = spark.read.parquet(path)
    pages = rows.groupBy("book_id", "page_num").agg(F.max("page_width").alias("width"), F.max("page_height").alias("height"))
    return line_table(rows), pages


def conformed(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` in the columns and types of ``schema``; names match in any case, absent columns are null."""
    wanted = rows.sparkSession.createDataFrame([], schema).schema
    have = {f.name.lower(): f for f in rows.schema}

    def column(f):
        if f.name not in have:
            return F.lit(None).cast(f.dataType)
        same = have[f.name].dataType == f.dataType or f.dataType.typeName() == "string" and have[f.name].dataType.typeName() in ("char", "varchar")
        return F.col(have[f.name].name) if same else F.col(have[f.name].name).cast(f.dataType)  # a cast would keep filters from a database

    return rows.select(*[column(f).alias(f.name) for f in wanted])


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet", **options: str) -> DataFrame:
    """``texts`` or ``analysis_results`` (``TEXTS``, ``RESULTS``) from files of ``kind``; columns
    that are absent are null."""
    return conformed(spark.read.format(kind).options(**options).load(path), schema)


def read_jdbc(spark: SparkSession, url: str, table: str, schema: str, by: str | None = None, partitions: int = 8, where: str | None = None, **options: str) -> DataFrame:
    """A database's ``texts`` or ``analysis_results``, read in ``partitions`` by ranges of ``by``, a
    numeric or time column (rows without a value are in the first).

    The bounds are the column's own, asked of the database. ``where`` is an SQL condition for the
    database, for the bounds as well; filters and columns of what is returned are pushed to it
    by Spark. ``options`` are the connection's (``user``, ``driver``, ``fetchsize``, ...).
    """
    if by is None and partitions > 1:
        raise ValueError("reading in partitions needs a column to divide by")
    rows = f"(SELECT * FROM {table} WHERE {where}) t" if where else table
    connection = {"url": url, **options}
    divided: dict = {}
    if partitions > 1:
        column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(by)
        bounds = f"(SELECT min({column}) AS lo, max({column}) AS hi FROM {rows}) b"
        lo, hi = spark.read.format("jdbc").options(**connection, dbtable=bounds).load().first()
        if lo != hi:  # else all rows have one value, or none
            divided = {"partitionColumn": by, "lowerBound": str(lo), "upperBound": str(hi), "numPartitions": partitions}
    return conformed(spark.read.format("jdbc").options(**connection, dbtable=rows, **divided).load(), schema)


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Append rows to a database's table, a connection and a transaction for each partition."""
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def chapters_of(results: DataFrame, column: str = "result_json") -> DataFrame:
    """Stored result documents -> a row per chapter; a missing index is 0."""
    parsed = results.withColumn("doc", F.from_json(column, RESULT))
    rows = parsed.select("job_id", F.explode("doc.chapters").alias("c"))
    return rows.select("job_id", F.coalesce("c.chapter_index", F.lit(0)).alias("chapter_index"), "c.title", "c.scores")


def blocks_of(results: DataFrame, column: str = "result_json") -> DataFrame:
    """Stored result documents -> a row per block; a missing index is 0."""
    rows = results.select("job_id", F.explode(F.from_json(column, RESULT)["blocks"]).alias("b"))
    return rows.select("job_id", F.coalesce("b.block_index", F.lit(0)).alias("block_index"), "b.chapter_index", "b.scene_index", "b.scene_ref", "b.top", "b.above")
