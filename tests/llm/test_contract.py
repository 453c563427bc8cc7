"""Contraction of links: labels against a walk of the graph, and the tasks that few links take."""

import random

import pytest

from corpusgraph.llm import neardup
from corpusgraph.llm.common import shuffles_freed

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def walked(n, links):
    label = list(range(n))
    while True:
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return dict(enumerate(label))


def frames(spark, n, links):
    labels = spark.range(n, numPartitions=3).selectExpr("id", "id AS label")
    return labels, spark.createDataFrame(links, "a long, b long").repartition(5)


@pytest.mark.parametrize("few", [0, 40])
def test_labels_of_any_number_of_links(spark, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few, raising=False)
    draw = random.Random(5)
    places = list(range(40, 120))
    draw.shuffle(places)
    links = [(draw.randrange(30), draw.randrange(40)) for _ in range(20)] + list(zip(places, places[1:]))[::2] + list(zip(places[:40], places[1:40])) + [(7, 7), (3, 9), (9, 3), (3, 9)]
    labels, pairs = frames(spark, 130, links)
    got = neardup.contract(labels, pairs)
    assert dict(map(tuple, got.collect())) == walked(130, links)
    # a second set of links goes on from labels that aren't the ids any more
    more = [(places[0], 2), (125, 126), (126, 127)]
    again = neardup.contract(got, frames(spark, 1, more)[1])
    assert dict(map(tuple, again.collect())) == walked(130, links + more)


def test_few_links_take_few_tasks(spark):
    sc, n = spark.sparkContext, 32
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    places = list(range(60))
    random.Random(3).shuffle(places)
    links = list(zip(places, places[1:]))
    labels, pairs = frames(spark, 60, links)
    try:
        for k, v in zip(held, (str(n), "false")):
            spark.conf.set(k, v)
        sc.setJobGroup("few links", "")
        got = neardup.contract(labels, pairs).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {r["label"] for r in got} == {0}
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert 0 < tasks < 10 * n


def test_guessed_sizes_do_not_multiply(spark):
    df = spark.range(50).selectExpr("id AS a", "id + 1 AS b")
    for _ in range(12):  # a guess of 4,000 digits and more, were it kept
        df, n = neardup.sized(df.join(df.selectExpr("a AS b", "b AS c"), "b").selectExpr("a", "b"))
    assert n == df.count() == 38
    said = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert len(said) < 8


def test_shuffles_are_kept_again_afterwards(spark):
    before = spark.conf.get(FREED)
    with shuffles_freed(spark):
        assert spark.conf.get(FREED) == "true"
    assert spark.conf.get(FREED) == before
    with pytest.raises(ZeroDivisionError), shuffles_freed(spark):
        1 / 0  # noqa: B018
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")], "doc_id long, text string")
    got = neardup.near_duplicates(docs)
    assert spark.conf.get(FREED) == before
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, got.collect())) == [(1, 3, 1), (2, 3, 1), (3, 1, 3)]
