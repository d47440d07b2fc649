"""Neighbours and sums that are cut into runs equal those of one window over the whole group."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import sampling
from colloquy.operators.ordered import in_rows, in_time, nearest, running_sum


def rows(spark, n=400):
    r, at, out = random.Random(4), datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 0, 30, 900, 4000, 20000]))
        out.append((i, "big" if r.random() < 0.9 else r.choice("ab"), at, r.choice([None, "x", "y"]), r.randint(0, 3)))
    return spark.createDataFrame(out, "row_idx long, topic string, ts timestamp, mark string, v int")


def test_nearest_equals_a_window_over_the_group(spark):
    df = rows(spark)
    w = Window.partitionBy("topic").orderBy("ts", "row_idx")
    whole = df.withColumns({"p": F.last("mark", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "n": F.first("mark", True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    cut = nearest(nearest(df, F.col("mark"), "p", ["topic"], in_time()), F.col("mark"), "n", ["topic"], in_time(), later=True)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    assert nearest(df.limit(0), F.col("mark"), "p", ["topic"], in_time()).count() == 0


def test_running_sum_equals_a_window_over_the_group(spark):
    df = rows(spark)
    w = Window.partitionBy("topic").orderBy("ts", "row_idx").rowsBetween(Window.unboundedPreceding, 0)
    whole = {(r["row_idx"], r["s"]) for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    assert {(r["row_idx"], r["s"]) for r in running_sum(df, F.col("v"), "s", ["topic"], in_time()).collect()} == whole
    total = {r["row_idx"]: r["s"] for r in running_sum(df, F.lit(1), "s", [], in_rows()).collect()}
    assert total == {i: i + 1 for i in range(400)}


def test_no_window_without_a_key_in_samples(spark):
    df = rows(spark)
    picked = sampling.stratified(df, "row_idx", {"x": F.col("mark") == "x", "low": F.col("v") == 0}, 5, 12, cover=("topic", 2))
    got = picked.collect()
    assert len(got) == 12 and sum(r["stratum"] == "cover" for r in got) == 2 and sum(r["stratum"] == "x" for r in got) == 5
    assert sorted(map(str, got)) == sorted(map(str, sampling.stratified(df.repartition(7), "row_idx", {"x": F.col("mark") == "x", "low": F.col("v") == 0}, 5, 12, cover=("topic", 2)).collect()))
