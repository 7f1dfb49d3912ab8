import os
import time

import pytest
from pyspark.sql import functions as F

from assetloom.sources.shared import FREED, passing, written


def shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")



def test_shuffles_of_a_written_table_are_freed(spark):
    rows = spark.range(20_000).withColumn("k", F.col("id") % 100)
    held = rows.groupBy("k").count().collect()  # its files stay
    before = shuffle_files(spark)
    table = written(rows.join(rows.groupBy("k").count().hint("merge"), "k"), "freed")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert table.count() == 20_000 and len(held) == 100
    assert spark.conf.get(FREED) == "false"


def test_passing_tables_go_and_kept_ones_stay(spark):
    with passing(spark):
        with passing(spark):
            first = written(spark.range(5), "first")
            second = written(first.where("id > 1"), "second", kept=True)
            third = written(second.where("id > 2"), "third")
            files = third.inputFiles(), second.inputFiles()
        assert second.count() == 3 and not any(os.path.exists(f.removeprefix("file://")) for f in files[0])
        last = written(second, "last", kept=True)
    assert last.count() == 3 and not any(os.path.exists(f.removeprefix("file://")) for f in files[1])
    with pytest.raises(ZeroDivisionError), passing(spark):
        gone = written(spark.range(5), "gone").inputFiles()
        _ = 1 / 0
    assert gone and not any(os.path.exists(f.removeprefix("file://")) for f in gone)
    assert written(spark.range(5), "stays").count() == 5
