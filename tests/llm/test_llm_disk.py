"""What steps leave on the disk, and what connecting a few edges costs."""

import random
import time

import pytest

from foliary.llm import common, components


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("step", [common.cut, common.staged])
def test_a_step_deletes_its_shuffle_files(spark, step):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    sums = spark.range(20_000).selectExpr("id % 100 AS k", "id").groupBy("k").sum("id")
    before, setting = shuffle_files(spark), spark.conf.get(key)
    out = step(sums)
    until = time.time() + 10  # executors delete them meanwhile
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(key) == setting
    want = sorted((k, sum(range(k, 20_000, 100))) for k in range(100))
    assert sorted(map(tuple, out.collect())) == want == sorted(map(tuple, sums.collect())) == sorted(map(tuple, step(sums).collect()))


def random_edges(rng, n, m):
    return [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(m)]


@pytest.mark.parametrize("edges", [[], [(None, 3), (5, 5), (3, None)], [(i, i + 1) for i in range(-200, 200)], [(i + 1, i) for i in range(200, -200, -1)], [(7, i) for i in range(300)], random_edges(random.Random(3), 500, 420), random_edges(random.Random(4), 1 << 62, 50)])
def test_components_by_one_task_and_by_joins(spark, edges):
    near, want = {}, {}
    for a, b in edges:
        if None not in (a, b):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for x in sorted(near):
        queue = [] if x in want else [x]
        while queue:
            if (y := queue.pop()) not in want:
                want[y] = x
                queue += near[y]
    want = sorted((u, v) for u, v in want.items() if u != v)
    rows = spark.createDataFrame(edges, "a bigint, b bigint")
    assert sorted(map(tuple, components.components(rows).collect())) == want
    assert sorted(map(tuple, components.components(rows, alone=-1).collect())) == want


def test_few_edges_cost_few_tasks(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(500)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        out = components.components(rows)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 500
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("few edges") for s in status.getJobInfo(j).stageIds}
    done = sum(i.numCompletedTasks for s in stages if (i := status.getStageInfo(s)))
    assert 0 < done <= 6 * int(spark.conf.get("spark.sql.shuffle.partitions"))
