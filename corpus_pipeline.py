"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
the columns of ``documents``; the last returns the mixed corpus, a row per copy. Stages are
written and reread, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import toxicity as tox
from folioscope.llm.decontaminate import decontaminated
from folioscope.llm.mixing import mix, repeated
from folioscope.llm.ngram_join import one_per_group
from folioscope.llm.pii import pseudonymised
from folioscope.llm.queries import pii_key
from folioscope.llm.tables import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; the model learns from all labelled documents."""
    model = tox.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return tox.kept(docs, model).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_per_group(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by pseudonyms of the same format."""
    return pseudonymised(docs, pii_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their weights; a row per copy."""
    return repeated(mix(docs)).select(*COLUMNS, "copy_no", F.col("mix_size").alias("size"), F.col("mix_target").alias("target"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity stage fits a model, which SQL can't express; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None
