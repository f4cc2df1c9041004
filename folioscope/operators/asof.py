"""As-of join: every row gets the last mark at or before it.

Rows and marks of a key are sorted together in ranges of ``size`` places, so a task's windows
are over at most that many rows whatever a key holds. What a range begins with is the last mark
of the ranges before it: a window over one row a range finds it, and it joins the range as a mark
in front of all others. One exchange, no row meets more than one mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_last(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, values: list[str], name: str, size: int = 4096) -> DataFrame:
    """``rows`` with a struct ``name`` of the ``values`` of the last mark with mark.at <= row.at
    (null if there is none). Places ``at`` are whole numbers from 0; a null key matches a null
    key; of several marks at one place the one with the largest values counts."""
    place, part = F.col(at).cast("long"), F.floor(F.col(at) / size).cast("long")
    mark = F.struct(*[F.col(v) for v in values])
    marks = marks.select(*keys, place.alias("_at"), part.alias("_part"), mark.alias(name))
    ends = marks.groupBy(*keys, "_part").agg(F.max(F.struct("_at", name))[name].alias(name))
    spans = ends.select(*keys, "_part", name, F.lit(True).alias("_ends")).unionByName(rows.select(*keys, part.alias("_part")).distinct(), allowMissingColumns=True)
    spans = spans.groupBy(*keys, "_part").agg(F.max_by(name, "_ends").alias(name))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = spans.select(*keys, F.lit(-1).cast("long").alias("_at"), "_part", F.last(name, ignorenulls=True).over(before).alias(name)).where(F.col(name).isNotNull())
    own = rows.withColumns({"_at": place, "_part": part, "_row": F.lit(True)})
    both = own.unionByName(marks.unionByName(carried).withColumn("_row", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_part").orderBy("_at", "_row", name).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(order)).where("_row").drop("_at", "_part", "_row")
