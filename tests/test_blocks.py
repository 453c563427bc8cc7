"""Block scans against windows over whole groups; groups of all sizes, nulls among the keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.operators.blocks import Blocks, numbered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = [(rng.choice(("hot", "hot", "hot", "a", "b", None)), k, rng.choice((None, rng.randrange(100))), rng.choice((None, "x", "y"))) for k in range(900)] + [("one", 5000, 1, None)]
    return spark.createDataFrame(data, "g string, seq long, v long, s string").repartition(5)


def test_equals_windows(spark, rows):
    b = Blocks(rows, "g", "seq", parts=4)
    assert b.rows.filter("g = 'hot'").select(b.block).distinct().count() > 1  # a hot group is in several blocks
    got = b.scan("n", {"total": F.coalesce("v", F.lit(0))}, {"high": F.col("v")}, {"known": F.col("s")}, {"p_v": "v", "p_seq": F.col("seq") * 2}).done()
    w = Window.partitionBy("g").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("total"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("high"),
        F.last("s", ignorenulls=True).over(upto).alias("known"), F.lag("v").over(w).alias("p_v"), F.lag(F.col("seq") * 2).over(w).alias("p_seq"),
    )
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_scans_follow_one_another(rows):
    b = Blocks(rows, "g", "seq", parts=4).scan(sums={"total": F.coalesce("v", F.lit(0))}).scan(last={"at_y": F.when(F.col("s") == "y", F.col("total"))})
    w = Window.partitionBy("g").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("total", F.sum(F.coalesce("v", F.lit(0))).over(w)).withColumn("at_y", F.last(F.when(F.col("s") == "y", F.col("total")), ignorenulls=True).over(w))
    assert sorted(map(str, b.done().collect())) == sorted(map(str, want.collect()))


def test_no_window_over_a_whole_group(rows):
    plan = numbered(rows, "g", "seq", "k")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line and "row_number" in line]
    assert windows and all("__block" in line for line in windows)


def test_empty(rows):
    assert numbered(rows.limit(0), "g", "seq", "k").count() == 0
