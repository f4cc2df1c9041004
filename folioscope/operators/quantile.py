"""Exact medians of groups of any size, by narrowing histograms.

No group is gathered: a round counts a group's values in ``bins`` equal steps between its bounds
(partial counts, minima and maxima go over the shuffle, ``bins`` rows a group at most), picks
the step with the middle and takes that step's least and largest value as the next bounds.
A group is done when its step has one value, or when its two middle values lie in different
steps: they are the one's largest and the other's least. Bounds are values of the group, so every
round takes at least one value off; scores of six decimals need two or three rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut, dropped
from .layout import matched


def exact_medians(rows: DataFrame, keys: list[str], value: str, bins: int = 1024, name: str = "median") -> DataFrame:
    """(keys, median) of every group with a value; a null key is a group like others. Nulls and
    NaN are no values; the median of an even number is the mean of the middle two."""
    v = F.col(value).cast("double")
    rows = rows.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    done = lambda lo, hi: F.when(lo == hi, lo)
    state = cut(bounds.withColumns({"_below": F.lit(0).cast("long"), "_middle": done(F.col("_lo"), F.col("_hi"))}))
    found, spent = [state.where("_middle IS NOT NULL")], [state]
    state = state.where("_middle IS NULL")
    while not state.isEmpty():
        inside = matched(rows, state, keys).where("_v >= _lo AND _v <= _hi")
        step = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))
        step = F.when(F.col("_v") == F.col("_hi"), bins - 1).when(F.col("_v") == F.col("_lo"), 0).otherwise(step)
        counted = inside.groupBy(*keys, "_n", "_below", step.alias("_step")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        order = Window.partitionBy(*keys).orderBy("_step")  # ``bins`` rows at most
        upto = F.col("_below") + F.sum("_c").over(order)
        counted = counted.withColumns({"_upto": upto, "_next": F.lead("_lo").over(order)})
        first, second = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
        middle = counted.where((F.col("_upto") > first) & (F.col("_upto") - F.col("_c") <= first))
        value_of = F.when(F.col("_upto") <= second, (F.col("_hi") + F.col("_next")) / 2).otherwise(done(F.col("_lo"), F.col("_hi")))
        state = cut(middle.select(*keys, "_n", "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_below"), value_of.alias("_middle")))
        spent.append(state)
        found.append(state.where("_middle IS NOT NULL"))
        state = state.where("_middle IS NULL")
    out = found[0].select(*keys, F.col("_middle").alias(name))
    for more in found[1:]:
        out = out.unionByName(more.select(*keys, F.col("_middle").alias(name)))
    out = cut(out)
    dropped(*spent)
    return out
