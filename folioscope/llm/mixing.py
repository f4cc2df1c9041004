"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed per source (partial sums before the shuffle), sources get weights, and
the corpus' total is shared by weight with a ceiling of ``max_repeat`` times a source's
size, the excess going to the others by weight. A source's rate is target over size; each
document is taken floor(rate) times plus once more if a hash of its id (and the seed),
read as a number in [0, 1), is below the fraction. The per-source table has one row per
source, so its window is as small as the list of sources.

The draw is one per document, so a source's taken words have the spread of its documents:
with few documents, or one that is most of its source, they can be far from the target.
A null, empty or very long text is counted like any other (null: size 0); a null source is a source of its own, last in order. Rows that
repeat a doc_id share one draw; a null id draws as the word null. Sources of size 0 get
target 0. Extra columns are kept (those named like the results are replaced). An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Capped sources are those with the smallest ceiling per weight: in that order the level
    (what is left over the weight that is left) is tried after every prefix of ceilings,
    and a source gets the least of its ceiling and weight times the last level that holds.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("ceiling", F.col("source_size").cast("double") * max_repeat).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("spent", F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("left_weight"))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return t.withColumn("target", F.least("ceiling", F.coalesce(F.col("weight") * level, F.col("ceiling")))).select("source", "source_size", "weight", "target")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = "mix"
) -> DataFrame:
    """Every row of ``docs`` with mix_size, mix_source_size, mix_target and mix_copies; columns
    of these names in ``docs`` are replaced, unless they are the key, text or source."""
    ours = {"mix_size", "mix_source", "mix_source_size", "mix_target", "mix_copies"}
    if taken := ours & {key, text, source}:
        raise ValueError(f"rename the input columns {sorted(taken)}")
    docs = docs.drop(*ours).withColumn("mix_size", size_of(F.col(text)))
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum("mix_size").alias("source_size"))
    plan = source_targets(sizes, weights, max_repeat).select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    out = docs.join(plan, F.col(source).eqNullSafe(F.col("mix_source"))).drop("mix_source")
    rate = F.when(F.col("mix_source_size") > 0, F.least(F.col("mix_target") / F.col("mix_source_size"), F.lit(float(max_repeat)))).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (draw(F.col(key), seed) < rate - whole).cast("long")
    return out.withColumn("mix_copies", (whole + extra).cast("long"))


def repeated(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: a row per copy, with copy_no from 1."""
    return docs.where("mix_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
