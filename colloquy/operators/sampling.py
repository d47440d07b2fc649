"""Samples for review: uniform, stratified, and around anchors; the same for a seed whatever the partitioning.

Rows are ranked by the MD5 of seed and id, which any other engine can repeat. Picks differ from those of
other random generators; sizes, coverage and repeatability are what counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SEED = 20260914


def place(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def uniform(rows: DataFrame, key: str, k: int = 100, seed: int = SEED) -> DataFrame:
    return rows.withColumn("_place", place(seed, key)).orderBy("_place", key).limit(k).drop("_place")


def stratified(
    rows: DataFrame, key: str, strata: dict[str, Column], each: int, total: int, seed: int = SEED, by: list[str] | None = None, scarce_first: bool = False, cover: tuple[str, int | None] | None = None, overlap: bool = False
) -> DataFrame:
    """rows with stratum: up to each of every stratum in turn, then others (stratum rest) up to total; for each value of by, if given.

    A row counts for the first stratum that picks it. With scarce_first the smallest stratum picks first. cover
    names a column and a number: one row of each of so many of its values (None: of all) comes first, as
    stratum cover. With overlap a stratum picks among all its rows, those that others have picked included. Only the first rows of each stratum can be picked, so no task sees more than those.
    """
    parts = by or []
    names = list(strata)
    marked = rows.withColumns({"_place": place(seed, key), "_key": F.col(key)})
    first = None
    if cover:
        column, most = cover
        values = marked.where(F.col(column).isNotNull()).groupBy(*parts, column).agg(F.min_by("_key", F.struct("_place", "_key")).alias("_first"))
        if most is not None:
            value_rank = F.row_number().over(Window.partitionBy(*parts).orderBy(place(seed, *parts, column), column))
            values = values.withColumn("_v", value_rank).where(F.col("_v") <= most)
        first = values.select(*parts, F.col("_first").alias("_key"))
        marked = marked.join(first.select("_key"), "_key", "left_anti")
    inside = [F.when(F.coalesce(c, F.lit(False)), i) for i, c in enumerate(strata.values())]
    long = marked.select(*parts, "_key", "_place", F.explode(F.array_compact(F.array(*inside, F.lit(len(names))))).alias("_in"))
    rank = F.row_number().over(Window.partitionBy(*parts, "_in").orderBy("_place", "_key"))
    head = long.withColumn("_rank", rank).where(F.col("_rank") <= total + each).drop("_rank")
    sizes = long.groupBy(*parts, "_in").agg(F.count("*").alias("_size"))
    short = head.join(sizes, [*parts, "_in"])
    if first is not None and parts:
        short = short.join(first.groupBy(*parts).agg(F.count("*").alias("_used")), parts, "left")
    elif first is not None:
        short = short.crossJoin(F.broadcast(first.agg(F.count("*").alias("_used"))))
    else:
        short = short.withColumn("_used", F.lit(0))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in short.select(*parts, "_key").schema)

    arrow = to_arrow_schema(T.StructType([*short.select(*parts, "_key").schema, T.StructField("stratum", T.StringType())]))

    def pick(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["_place"], r["_key"]))
        left, taken = total - int(rows[0]["_used"] or 0), {}
        size = {r["_in"]: r["_size"] for r in rows}
        turn = sorted(range(len(names)), key=lambda i: (size.get(i, 0), i)) if scarce_first else list(range(len(names)))
        for i in [*turn, len(names)]:
            last = i == len(names)
            free = [r["_key"] for r in rows if r["_in"] == i and (r["_key"] not in taken or (overlap and not last))]
            most = max(0, left - len(taken)) if last else max(0, min(each, left - len(taken)))
            for k in free[:most]:
                taken.setdefault(k, "rest" if last else names[i])
        return pa.Table.from_pylist([{p: rows[0][p] for p in parts} | {"_key": k, "stratum": v} for k, v in taken.items()], schema=arrow)

    keys = parts or ["_all"]
    picked = short.withColumn("_all", F.lit(1)).groupBy(*keys).applyInArrow(pick, f"{types}, stratum string").select("_key", "stratum")
    if first is not None:
        picked = picked.union(first.select("_key", F.lit("cover")))
    return rows.join(picked, F.col(key) == F.col("_key")).select(*rows.columns, "stratum")


def around(rows: DataFrame, anchors: DataFrame, key: str = "row_idx", reach: int = 3) -> DataFrame:
    """Rows up to reach positions from an anchor, with the anchor's position; an equi-join, since positions are whole numbers."""
    spread = anchors.select(F.col(key).alias("anchor"), F.explode(F.sequence(F.col(key) - reach, F.col(key) + reach)).alias(key))
    return rows.join(spread, key)


def excerpt(members: DataFrame, centre: Column, size: int = 5) -> DataFrame:
    """Up to size rows of each conversation around the row for which centre holds, moved inward at its ends."""
    w = Window.partitionBy("conversation_id")
    placed = members.withColumns({"_n": F.row_number().over(w.orderBy("row_idx")), "_size": F.count("*").over(w)}).withColumn("_at", F.min(F.when(centre, F.col("_n"))).over(w))
    start = F.greatest(F.lit(1), F.least(F.col("_at") - size // 2, F.col("_size") - size + 1))
    return placed.where((F.col("_n") >= start) & (F.col("_n") < start + size)).drop("_n", "_size", "_at")
