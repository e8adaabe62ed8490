"""Near duplicates and their components need few stages, in one task or in several."""

import random

import numpy as np


def test_near_duplicates_take_few_stages(spark):
    from mnemospark.llm import near_dups

    from .test_operators import near_rows

    docs = spark.createDataFrame(near_rows(), "doc_id long, text string").repartition(3)
    sc, seen = spark.sparkContext, set()
    sc.setJobGroup("near-dup-stages", "near duplicates")
    try:
        near_dups.near_duplicates(docs, leaf=60).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    tracker = sc.statusTracker()
    for job in tracker.getJobIdsForGroup("near-dup-stages"):
        seen.update(s for s in tracker.getJobInfo(job).stageIds if (info := tracker.getStageInfo(s)) and info.numCompletedTasks)
    assert len(seen) <= 90  # 60; with joins in place of tasks of links and with more tables between them 131


def test_components_of_links_that_need_several_tasks(spark, monkeypatch):
    from mnemospark.llm import components as module

    r = random.Random(5)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(7, 7), (500, -501), (None, 3)]
    a, b = np.array([x for x in links if None not in x and x[0] != x[1]]).T
    want = dict(zip(*(x.tolist() for x in module.least_reached(a, b)), strict=True))
    assert want[360] == 300 and want[500] == -501
    for bound in (1 << 20, 50):
        monkeypatch.setattr(module, "TASK_LINKS", bound)
        rows = module.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
        assert len(rows) == len(want) and {x.id: x.component for x in rows} == want
