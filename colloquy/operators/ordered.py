"""Neighbours and running sums in an order, without a task that holds all rows or all rows of a group.

Rows are cut into runs: of SPAN positions, or of an hour. Inside a run a window does the work; what crosses a
run's start comes from a table with one row for each run, which is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 100_000


def in_time() -> tuple[list[str], Column]:
    """The order by time and then row, and runs of an hour."""
    return ["ts", "row_idx"], F.floor(F.unix_seconds("ts") / 3600)


def in_rows(order: str = "row_idx") -> tuple[list[str], Column]:
    """The order by row, and runs of SPAN rows."""
    return [order], F.floor(F.col(order) / SPAN)


def nearest(df: DataFrame, value: Column, name: str, by: list[str], line: tuple[list[str], Column], later: bool = False) -> DataFrame:
    """df with name: value in the nearest earlier (or later) row of the same by where it is not null.

    line is an order and the run of each row, which must ascend with the order; by must not be null.
    """
    order, run = line
    way = [F.col(c).desc() if later else F.col(c).asc() for c in order]
    before = (Window.unboundedPreceding, -1)
    cut = df.withColumns({"_run": run, "_value": value})
    inner = cut.withColumn("_inner", F.last("_value", True).over(Window.partitionBy(*by, "_run").orderBy(*way).rowsBetween(*before)))
    place = F.struct(*order)
    pick = (F.min_by if later else F.max_by)("_value", place)
    ends = cut.where("_value is not null").groupBy(*by, "_run").agg(pick.alias("_end"))
    every = cut.select(*by, "_run").distinct().join(ends, [*by, "_run"], "left")
    runs = Window.partitionBy(*by).orderBy(F.col("_run").desc() if later else F.col("_run").asc()).rowsBetween(*before)
    edge = every.select(*by, "_run", F.last("_end", True).over(runs).alias("_edge"))
    return inner.join(edge, [*by, "_run"]).select(*df.columns, F.coalesce("_inner", "_edge").alias(name))


def with_previous(df: DataFrame, columns: dict[str, str], order: str = "row_idx") -> DataFrame:
    """df with each new name holding the value of its column in the row before; null in the first row."""
    cut = df.withColumn("_run", F.floor(F.col(order) / SPAN))
    carried = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    inner = cut.withColumn("_inner", F.lag(carried).over(Window.partitionBy("_run").orderBy(order)))
    last = cut.groupBy("_run").agg(F.max_by(carried, order).alias("_last"))
    edge = last.select("_run", F.lag("_last").over(Window.orderBy("_run")).alias("_edge"))
    joined = inner.join(edge, "_run")
    return joined.select(*df.columns, *[F.coalesce("_inner", "_edge")[n].alias(n) for n in columns])


def with_running_sum(df: DataFrame, value: Column, name: str, order: str = "row_idx") -> DataFrame:
    """df with the sum of value over all rows up to and including each."""
    return running_sum(df, value, name, [], in_rows(order))


def running_sum(df: DataFrame, value: Column, name: str, by: list[str], line: tuple[list[str], Column]) -> DataFrame:
    """df with the sum of value over the rows of the same by up to and including each."""
    order, run = line
    cut = df.withColumns({"_run": run, "_value": value})
    own = Window.partitionBy(*by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumn("_inner", F.sum("_value").over(own))
    total = cut.groupBy(*by, "_run").agg(F.sum("_value").alias("_total"))
    runs = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    edge = total.select(*by, "_run", F.coalesce(F.sum("_total").over(runs), F.lit(0)).alias("_edge"))
    return inner.join(edge, [*by, "_run"]).select(*df.columns, (F.col("_inner") + F.col("_edge")).cast("long").alias(name))
