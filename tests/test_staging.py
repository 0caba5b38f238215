"""What staging leaves on disk."""

import os
import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators import traces
from spanloom.operators.staging import passing, stage
from spanloom.plans import event_queries

SF = "/root/testdata/sf0.001"


def folders(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    return {f for f in os.listdir(base) if f.startswith("stage-")} if os.path.isdir(base) else set()


def shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i).getName()) for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def left(spark, before):
    for _ in range(50):  # files are deleted in the background
        if not shuffled(spark) - before:
            break
        time.sleep(0.2)
    return shuffled(spark) - before


def test_shuffle_files_go_with_the_job_that_stages(spark):
    before, rows = shuffled(spark), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    staged = stage(rows)
    assert not left(spark, before)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert staged.count() == rows.count() == 7


def test_passing_tables_go_but_for_those_kept(spark):
    before = folders(spark)
    with passing(spark) as keep_outer:
        with passing(spark) as keep:
            once = stage(spark.range(10))
            inner = keep(once.withColumn("x", F.col("id") * 2))
            assert len(folders(spark) - before) == 2
        assert inner.count() == 10
        kept = keep_outer(inner.filter("id > 4"))
    assert len(folders(spark) - before) == 1
    assert sorted(r.x for r in kept.collect()) == [10, 12, 14, 16, 18]


def test_spawn_spans_leave_one_table(spark):
    before = folders(spark)
    assert event_queries.event_spawn_spans(spark, SF).count() > 0
    assert len(folders(spark) - before) == 1


def test_a_tree_leaves_spans_and_places(spark):
    before = folders(spark)
    chain = spark.range(20).select(F.lit("t").alias("t"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.col("id").alias("s"))
    chain = chain.unionByName(chain.filter("id = 7"))  # a span that came twice
    got = traces.tree_order(chain, "t", "id", "up", "s", "s")
    assert len(folders(spark) - before) == 2
    assert sorted((r.id, r.depth, r.place) for r in got.collect()) == sorted([(i, i, i + 1 + (i > 7)) for i in range(20)] + [(7, 7, 9)])


@pytest.mark.parametrize("name", ["event_spans", "event_attributes"])
def test_event_queries_hold_staged_tables_only(spark, name):
    before = shuffled(spark)
    spans = getattr(event_queries, name)(spark, SF)
    assert not left(spark, before)
    assert spans.count() > 0
