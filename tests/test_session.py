"""Intermediate tables of jobs that run side by side."""

import os
import re
import threading
import time

from stmtflow.session import cut_lineage, scratch


def test_a_job_deletes_only_its_own_tables(spark):
    """Two jobs in two threads: the one that ends first leaves the other's tables alone."""
    written, ended, seen = threading.Event(), threading.Event(), []

    def long_job():
        with scratch(spark):
            table = cut_lineage(spark.range(5))
            written.set()
            ended.wait(60)
            seen.append((table.count(), table.inputFiles()[0]))

    other = threading.Thread(target=long_job)
    other.start()
    written.wait(60)
    with scratch(spark):
        own = cut_lineage(spark.range(3)).inputFiles()[0].removeprefix("file://")
    ended.set()
    other.join()
    assert seen and seen[0][0] == 5
    assert not os.path.exists(own) and not os.path.exists(seen[0][1].removeprefix("file://"))


def test_a_cut_table_leaves_no_shuffle_files(spark):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in re.findall(r"shuffle_\d+_[^,/)]*data", disk.getAllFiles().toString())}

    before = files()
    cut = cut_lineage(spark.range(1000).repartition(3).groupBy("id").count())
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and cut.count() == 1000
    kept = spark.range(1000).groupBy("id").count()
    assert kept.count() == 1000 == kept.count()  # other frames keep theirs
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") != "true"
