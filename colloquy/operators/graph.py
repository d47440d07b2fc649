"""The reply graph: parents, ancestors by pointer doubling, components, topics, and graphs of senders.

A message has one parent at most, so replies are a forest. One table of ancestors answers chain depth,
topic and component: doubling finds the first ordinary message of each chain, and what that one replies to
(a service row, a missing message, nothing) decides the rest.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.messages import TOPIC_MARK


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where the driver runs the tasks as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    return named


def persisted(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that loops keep a short lineage."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)


def parents(messages: DataFrame) -> DataFrame:
    """Each row with parent_id and parent_type: the message that it replies to, if that is there.

    A reply names an id and perhaps a file; without one it is the row's own file. Ids are unique in a
    checked table, so the file only has to agree.
    """
    target = messages.select(
        F.col("message_id").alias("parent_id"), F.col("source_file").alias("_file"), F.col("message_type").alias("parent_type"),
        F.col("text").alias("parent_text"), F.col("sender").alias("parent_sender"), F.col("ts").alias("parent_ts"), F.col("row_idx").alias("parent_row"),
    )
    on = (F.col("reply_to") == F.col("parent_id")) & (F.coalesce("reply_to_source_file", "source_file") == F.col("_file"))
    # rows that reply to nothing have one key, null: they stay out of the join
    joined = messages.where("reply_to is not null").join(target, on, "left").drop("_file")
    plain = messages.where("reply_to is null").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema if f.name != "_file"])
    return joined.unionByName(plain)


def direct_edges(linked: DataFrame) -> DataFrame:
    """(parent, child, gap_seconds) of ordinary messages that reply to ordinary messages."""
    both = linked.where("message_type = 'message' and parent_type = 'message'")
    return both.select(F.col("parent_id").alias("parent"), F.col("message_id").alias("child"), (F.unix_micros("ts") - F.unix_micros("parent_ts")).cast("double").__truediv__(1e6).alias("gap_seconds"))


def ancestors(messages: DataFrame, on_cycle: str = "raise") -> DataFrame:
    """A row for each ordinary message: head, depth, termination, root_id, topic, context, component, component_row, component_size.

    head is the first ordinary message of its chain, and names its component (component is its earliest
    row's id). depth counts resolved steps, one to a service row included. termination is service,
    missing_target, normal_no_reply or cycle. topic is the service row reached if that opens one. Replies
    that go round raise ValueError, or are rows with termination cycle (on_cycle='mark').
    """
    linked = persisted(parents(messages.select("row_idx", "message_id", "source_file", "message_type", "text", "sender", "ts", "reply_to", "reply_to_source_file")).where("message_type = 'message'"))
    near = F.col("parent_type") == "message"
    at = linked.select("message_id", F.when(near, F.col("parent_id")).otherwise(F.col("message_id")).alias("head"), F.when(near, 1).otherwise(0).cast("long").alias("steps"))
    n = at.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 2 if n else 0):
        above = at.select(F.col("message_id").alias("_id"), F.col("head").alias("_head"), F.col("steps").alias("_steps"))
        moved = persisted(at.join(above, at["head"] == above["_id"]).select("message_id", F.col("_head").alias("head"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("_head") != F.col("head")).alias("moved")))
        done = moved.where("moved").isEmpty()
        at = moved.drop("moved")
        if done:
            break
    top = linked.select(F.col("message_id").alias("_head"), F.col("reply_to").alias("_reply"), F.col("parent_id").alias("_parent"), F.col("parent_type").alias("_type"), F.col("parent_text").alias("_text"))
    full = at.join(top, at["head"] == top["_head"]).join(linked.select("message_id", "row_idx"), "message_id")
    cycle = F.col("_type") == "message"
    if on_cycle == "raise" and not full.where(cycle).isEmpty():
        raise ValueError("replies form a cycle")
    sized = full.groupBy(F.col("head").alias("_h")).agg(F.min_by("message_id", "row_idx").alias("component"), F.min("row_idx").alias("component_row"), F.count("*").alias("component_size"))
    topic = F.when((F.col("_type") == "service") & F.col("_text").contains(TOPIC_MARK), F.col("_parent"))
    return (
        full.join(sized, full["head"] == sized["_h"])
        .select(
            "message_id", "row_idx", "head",
            (F.col("steps") + F.when(F.col("_type") == "service", 1).otherwise(0)).cast("long").alias("depth"),
            F.when(cycle, "cycle").when(F.col("_type") == "service", "service").when(F.col("_reply").isNotNull(), "missing_target").otherwise("normal_no_reply").alias("termination"),
            F.coalesce(F.when(~F.coalesce(cycle, F.lit(False)), F.coalesce("_parent", "_reply")), "head").alias("root_id"),
            topic.alias("topic"),
            F.when(topic.isNotNull(), "topic").when(F.col("_parent").isNull() & F.col("_reply").isNotNull(), "missing_root").otherwise("unknown_root").alias("context"),
            "component", "component_row", "component_size",
        )
    )


def sender_graph(pairs: DataFrame) -> DataFrame:
    """Communities and graph figures of weighted sender pairs (from_sender, to_sender, n), as one row.

    Direction and pairs of one sender with itself do not count. Communities come from joining, again and
    again, the two whose union gains most modularity (the first such pair in order of degree, then name);
    the largest two-way cut is exact up to 20 senders and not computed beyond. The matrix has a row for each
    sender, so it is read in one task: senders are bounded by people, not by messages.
    """
    schema = "senders int, edges int, total_weight double, modularity double, communities array<array<string>>, isolated array<string>, internal_fraction double, max_cut_fraction double, max_cut_status string, max_cut_side array<string>"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b, n = (rows[c].to_pylist() for c in ("from_sender", "to_sender", "n"))
        return pa.Table.from_pylist([graph_figures(list(zip(a, b, n)))], schema=_arrow(schema))

    figures = pairs.select("from_sender", "to_sender", F.col("n").cast("double").alias("n"), F.lit(1).alias("one")).groupBy("one").applyInArrow(run, schema)
    return figures.crossJoin(F.broadcast(triangles(pairs)))


def links(pairs: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: undirected pairs of different senders."""
    some = pairs.where("from_sender <> to_sender and n > 0")
    return some.groupBy(F.least("from_sender", "to_sender").alias("a"), F.greatest("from_sender", "to_sender").alias("b")).agg(F.sum("n").alias("weight"))


def triangles(pairs: DataFrame) -> DataFrame:
    """One row: how many triples of senders are all linked, by joins of the pairs a < b < c."""
    e = links(pairs).select("a", "b")
    wedge = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
    return wedge.join(e.select("a", F.col("b").alias("c")), ["a", "c"]).agg(F.count("*").alias("triangles"))


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def graph_figures(pairs: list[tuple[str, str, float]]) -> dict:
    names = sorted({x for a, b, _ in pairs for x in (a, b)})
    at = {s: i for i, s in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b, n in pairs:
        if a != b:
            w[at[a], at[b]] += n
            w[at[b], at[a]] += n
    degree, total = w.sum(axis=1), w.sum() / 2
    groups = [[i] for i in range(len(names)) if degree[i]]
    between = w[np.ix_([g[0] for g in groups], [g[0] for g in groups])] if groups else np.zeros((0, 0))
    weight = np.array([degree[g[0]] for g in groups])
    while total and len(groups) > 1:
        gain = between / total - np.outer(weight, weight) / (2 * total * total)
        gain[np.tril_indices(len(groups))] = -np.inf
        best = gain.max()
        if best <= 1e-12:
            break
        i, j = np.argwhere(gain >= best - 1e-12)[0]
        groups[i] += groups[j]
        between[i] += between[j]
        between[:, i] += between[:, j]
        weight[i] += weight[j]
        between, weight = np.delete(np.delete(between, j, 0), j, 1), np.delete(weight, j)
        del groups[j]
    inside = [w[np.ix_(g, g)].sum() for g in groups]
    groups_by_weight = sorted(groups, key=lambda g: (-degree[g].sum(), min(g)))
    cut, side = max_cut(w) if 0 < len(names) <= 20 else (None, None)
    return {
        "senders": len(names), "edges": int(np.triu(w > 0, 1).sum()), "total_weight": float(total),
        "modularity": float(sum(x / (2 * total) - (degree[g].sum() / (2 * total)) ** 2 for x, g in zip(inside, groups))) if total else 0.0,
        "communities": [[names[i] for i in sorted(g)] for g in groups_by_weight], "isolated": [names[i] for i in range(len(names)) if not degree[i]],
        "internal_fraction": float(sum(inside) / 2 / total) if total else None,
        "max_cut_fraction": float(cut / total) if total and cut is not None else None, "max_cut_status": "exact" if cut is not None else "not_computed_node_limit",
        "max_cut_side": [names[i] for i in range(len(names)) if side[i]] if side is not None else None,
    }


def max_cut(w: np.ndarray) -> tuple[float, np.ndarray]:
    """The greatest weight across two sides, and one side; vertex 0 is on the other. All 2**(n-1) splits are weighed at once, a vertex at a time."""
    n = len(w)
    splits = np.arange(1 << (n - 1), dtype=np.int64) << 1
    total = np.zeros(len(splits))
    for i in range(n):
        for j in range(i + 1, n):
            if w[i, j]:
                total += w[i, j] * ((splits >> i ^ splits >> j) & 1)
    best = int(np.argmax(total))
    return float(total[best]), (splits[best] >> np.arange(n)) & 1
