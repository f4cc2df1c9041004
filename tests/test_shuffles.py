"""What the heading queries compute and shuffle: a text is split once, lines are dealt out once, shuffle files go."""

import re
import time

from folioscope.operators import headings as H
from folioscope.operators import layout as L
from folioscope.operators.cut import cut


def books(spark):
    return spark.createDataFrame([("b", "Chapter 1\nA line of text.\n\nChapter 2\nAnother line.")], "book_id string, text string")


def test_a_text_is_split_once(spark):
    assert L.txt_lines(books(spark))._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_lines_are_dealt_out_once(spark):
    plan = H.marked_lines(L.txt_lines(books(spark)))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange \w+", plan)) == 1 and "Join" not in plan


def test_a_cut_leaves_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(found.apply(k).getName().startswith("shuffle_") for k in range(found.size()))

    had = files()
    assert len(cut(spark.range(1000).repartition(7, "id")).collect()) == 1000
    for _ in range(40):
        if files() <= had:
            break
        time.sleep(0.5)
    assert files() <= had
