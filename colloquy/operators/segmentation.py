"""Candidate conversations: reply components, joined by short gaps of one sender within a topic.

Joins are greedy, the shortest gap first, and a candidate holds at most one component of several messages.
Topics do not meet, so each is merged by itself. Gaps are sorted, so one pass over the longest threshold
goes through the state of every shorter one: it is read off on the way.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.ordered import in_rows, in_time, nearest
from colloquy.operators.profile import seconds
from colloquy.operators.sampling import SEED, stratified

THRESHOLDS = (10, 30, 60, 120)


def weak_proposals(messages: DataFrame, found: DataFrame) -> DataFrame:
    """Neighbours in a topic, of one sender and different components: (topic, gap, a, b, row_a, row_b, component_a, component_b, size_a, size_b)."""
    rows = messages.select("message_id", "sender", "ts").join(found.where("topic is not null").select("message_id", "row_idx", "topic", "component", "component_size"), "message_id")
    prev = F.struct("message_id", "sender", "ts", "row_idx", "component", "component_size")
    pairs = nearest(rows, prev, "p", ["topic"], in_rows()).where("p is not null and p.sender = sender and p.component <> component")
    return pairs.select(
        "topic", seconds(F.col("ts"), F.col("p.ts")).alias("gap"), F.col("p.message_id").alias("a"), F.col("message_id").alias("b"),
        F.col("p.row_idx").alias("row_a"), F.col("row_idx").alias("row_b"), F.col("p.component").alias("component_a"),
        F.col("component").alias("component_b"), F.col("p.component_size").alias("size_a"), F.col("component_size").alias("size_b"),
    )


class Sets:
    """Disjoint sets that carry values; find halves its path, without recursion."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def merged(proposals: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, topic, kind, component, root, a, b, gap): how each threshold leaves a topic.

    kind `member` names the set of a component that joined another; `accepted` and `blocked` are decisions
    on proposals.
    """
    marks = sorted(thresholds)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        todo = sorted(zip(*(rows[c].to_pylist() for c in ("gap", "row_b", "row_a", "a", "b", "component_a", "component_b", "size_a", "size_b"))))
        sets, anchored, touched, out, log = Sets(), {}, [], [], []
        topic, at = key[0].as_py(), 0
        for m in marks:
            while at < len(todo) and todo[at][0] <= m * 60:
                gap, _, _, a, b, ca, cb, na, nb = todo[at]
                at += 1
                for c, n in ((ca, na), (cb, nb)):
                    if c not in anchored:
                        anchored[c] = n > 1
                        touched.append(c)
                ra, rb = sets.find(ca), sets.find(cb)
                if ra == rb:
                    continue
                if anchored[ra] and anchored[rb]:
                    log.append(("blocked", a, b, gap))
                    continue
                sets.up[rb] = ra
                anchored[ra] = anchored[ra] or anchored[rb]
                log.append(("accepted", a, b, gap))
            out += [(m, topic, "member", c, sets.find(c), None, None, None) for c in touched]
            out += [(m, topic, kind, None, None, a, b, gap) for kind, a, b, gap in log]
        cols = list(zip(*out)) if out else [[]] * 8
        types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], ["threshold", "topic", "kind", "component", "root", "a", "b", "gap"])

    return proposals.groupBy("topic").applyInArrow(run, "threshold int, topic string, kind string, component string, root string, a string, b string, gap double")


def membership(messages: DataFrame, found: DataFrame, decided: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, conversation_id, message_id, row_idx, topic): each ordinary message in one conversation of each threshold.

    A conversation is named after its first message.
    """
    every = found.select("message_id", "row_idx", "topic", "component", "component_row").crossJoin(F.broadcast(messages.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")))
    named = every.join(decided.where("kind = 'member'").select("threshold", "component", "root"), ["threshold", "component"], "left").withColumn("root", F.coalesce("root", "component"))
    first = named.groupBy("threshold", "root").agg(F.min("row_idx").alias("first_row"), F.min_by("message_id", "row_idx").alias("first"))
    return named.join(first, ["threshold", "root"]).select("threshold", F.concat(F.lit("candidate_"), "threshold", F.lit("m_"), "first").alias("conversation_id"), "message_id", "row_idx", "topic", "component")


def with_system_events(messages: DataFrame, members: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """members and a conversation of its own for every service row."""
    service = messages.where("message_type = 'service'").select("message_id", "row_idx").crossJoin(F.broadcast(messages.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")))
    own = service.select("threshold", F.concat(F.lit("context_"), "threshold", F.lit("m_"), "message_id").alias("conversation_id"), "message_id", "row_idx")
    return members.withColumn("candidate_type", F.lit("chat")).unionByName(own.withColumn("candidate_type", F.lit("system_event")), allowMissingColumns=True)


def conversations(messages: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each conversation: times, senders, sizes, components, replies within it, and the gaps over its threshold."""
    rows = members.join(messages.select("message_id", "ts", "sender"), "message_id")
    w = Window.partitionBy("threshold", "conversation_id").orderBy("row_idx")
    stepped = rows.withColumn("gap", seconds(F.col("ts"), F.lag("ts").over(w)))
    rolled = stepped.groupBy("threshold", "conversation_id").agg(
        F.max("topic").alias("topic"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("message_count"), F.countDistinct("sender").alias("sender_count"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_internal_gap_seconds"), F.array_sort(F.collect_set("component")).alias("components"), F.min("row_idx").alias("first_row"),
    )
    inner = edges.join(members.select("threshold", "conversation_id", F.col("message_id").alias("child")), "child")
    replies = inner.groupBy("threshold", "conversation_id").agg(F.count("*").alias("direct_reply_count"), F.count_if(F.col("gap_seconds") > F.col("threshold") * 60).alias("long_replies"))
    return rolled.join(replies, ["threshold", "conversation_id"], "left").withColumns({"duration_seconds": seconds(F.col("end_ts"), F.col("start_ts")), "direct_reply_count": F.coalesce("direct_reply_count", F.lit(0)), "long_replies": F.coalesce("long_replies", F.lit(0))})


def comparison(talks: DataFrame, decided: DataFrame, members: DataFrame, linked: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each threshold, from its conversations and merge decisions, its members, all rows with their parents, and ancestors."""
    n, d, m = F.col("message_count"), F.col("duration_seconds"), F.col("threshold") * 60
    at = lambda c, q: F.percentile(c, F.lit(q))
    out = talks.groupBy("threshold").agg(
        F.count("*").alias("conversations"), F.avg(n).alias("message_count_mean"), at(n, 0.5).alias("message_count_median"),
        at(n, 0.9).alias("message_count_p90"), F.max(n).alias("message_count_max"), F.avg(d).alias("duration_seconds_mean"),
        at(d, 0.5).alias("duration_seconds_median"), at(d, 0.9).alias("duration_seconds_p90"), F.max(d).alias("duration_seconds_max"),
        F.count_if(n == 1).alias("single_message_count"), (100 * F.count_if(n == 1) / F.count("*")).alias("single_message_percent"),
        F.count_if(n > 20).alias("over_20_messages"), F.count_if(n > 50).alias("over_50_messages"), F.count_if(n > 100).alias("over_100_messages"),
        F.sum("direct_reply_count").alias("direct_replies"), F.sum("long_replies").alias("direct_reply_edges_over_threshold"),
        F.count_if(F.col("max_internal_gap_seconds") > m).alias("conversations_with_gap_over_threshold"),
    )
    merges = decided.groupBy("threshold").agg(F.count_if(F.col("kind") == "accepted").alias("accepted_weak_links"), F.count_if(F.col("kind") == "blocked").alias("blocked_weak_links"))
    sent = (F.col("message_type") == "message") & F.col("reply_to").isNotNull()
    replies = linked.agg(
        F.count_if(F.col("message_type") == "service").alias("system_event_records"), F.count_if(sent & (F.col("parent_type") == "message")).alias("resolved_normal_direct_reply_count"),
        F.count_if(sent & (F.col("parent_type") == "service")).alias("topic_or_service_links"), F.count_if(sent & F.col("parent_id").isNull()).alias("unresolved_direct_reply_count"),
    )
    edges = linked.where("message_type = 'message' and parent_type = 'message'").select(F.col("parent_id").alias("parent"), F.col("message_id").alias("child"))
    where = members.select("threshold", "conversation_id", "message_id")
    ends = edges.join(where.select("threshold", F.col("message_id").alias("parent"), F.col("conversation_id").alias("a")), "parent").join(where.withColumnRenamed("message_id", "child"), ["threshold", "child"])
    broken = ends.where("a <> conversation_id").groupBy("threshold").agg(F.count("*").alias("broken_direct_reply_count"))
    held = members.join(found.select("message_id", "component_size"), "message_id").groupBy("threshold", "conversation_id").agg(F.countDistinct("topic").alias("topics"), F.countDistinct(F.when(F.col("component_size") > 1, F.col("component"))).alias("trees"))
    faults = held.groupBy("threshold").agg(F.count_if(F.col("topics") > 1).alias("multi_topic_conversations"), F.count_if(F.col("trees") > 1).alias("conversations_merging_multiple_nontrivial_reply_chains"))
    full = out.join(merges, "threshold", "left").join(broken, "threshold", "left").join(faults, "threshold").crossJoin(F.broadcast(replies))
    return full.fillna(0, ["accepted_weak_links", "blocked_weak_links", "broken_direct_reply_count"]).withColumn("total_output_records", F.col("conversations") + F.col("system_event_records"))


def sender_count_distribution(talks: DataFrame) -> DataFrame:
    return talks.groupBy("threshold", "sender_count").agg(F.count("*").alias("n"))


def stability(members: DataFrame) -> DataFrame:
    """(threshold, next_threshold, messages, unchanged, changed, unchanged_percent, conversation_count_change).

    A message is unchanged whose conversation keeps its size, hence its members, at the next threshold.
    """
    sizes = members.groupBy("threshold", "conversation_id").agg(F.count("*").alias("size"))
    sized = members.select("threshold", "conversation_id", "message_id").join(sizes, ["threshold", "conversation_id"])
    w = Window.partitionBy("message_id").orderBy("threshold")
    steps = sized.select("threshold", F.lead("threshold").over(w).alias("next_threshold"), (F.col("size") == F.lead("size").over(w)).alias("same")).where("next_threshold is not null")
    counts = sizes.groupBy("threshold").agg(F.count("*").alias("n"))
    rolled = steps.groupBy("threshold", "next_threshold").agg(F.count("*").alias("messages"), F.count_if("same").alias("unchanged"))
    both = rolled.join(counts, "threshold").join(counts.select(F.col("threshold").alias("next_threshold"), F.col("n").alias("next_n")), "next_threshold")
    changed = F.col("messages") - F.col("unchanged")
    return both.select("threshold", "next_threshold", "messages", "unchanged", changed.alias("changed"), (100 * F.col("unchanged") / F.col("messages")).alias("unchanged_percent"), (F.col("next_n") - F.col("n")).alias("conversation_count_change"))


def long_distance_replies(edges: DataFrame, over: int = 86400) -> DataFrame:
    return edges.where(F.col("gap_seconds") > over)


def topic_neighbours(messages: DataFrame, found: DataFrame) -> DataFrame:
    """Each message of a known topic with the ones before and after it there, by time and then row."""
    rows = messages.select("message_id", "sender", "ts", "reply_to").join(found.where("topic is not null").select("message_id", "row_idx", "topic"), "message_id")
    there = F.struct("message_id", "sender", "ts", "reply_to")
    near = nearest(nearest(rows, there, "_p", ["topic"], in_time()), there, "_n", ["topic"], in_time(), later=True)
    named = {f"{side}_{new}": F.col(f"{at}.{old}") for side, at in (("previous", "_p"), ("next", "_n")) for new, old in (("id", "message_id"), ("sender", "sender"), ("ts", "ts"), ("reply_to", "reply_to"))}
    near = near.withColumns(named).drop("_p", "_n")
    return near.withColumns({"gap_previous": seconds(F.col("ts"), F.col("previous_ts")), "gap_next": seconds(F.col("next_ts"), F.col("ts"))})


#: Candidates of a threshold that a review should see (fixed values: names and sizes of the strata).
REVIEW_EACH, REVIEW_TOTAL = 7, 50


def review_strata(talks: DataFrame) -> dict[str, Column]:
    """Strata of the review sample; the long spans are the top tenth of those longer than 0."""
    n = F.col("message_count")
    cut = talks.where("duration_seconds > 0").agg(F.percentile("duration_seconds", F.lit(0.9)).alias("cut")).first()["cut"]
    return {
        "short_1_2_messages": n <= 2, "medium_3_10_messages": n.between(3, 10), "long_11plus_messages": n >= 11, "multi_sender": F.col("sender_count") >= 2,
        "direct_reply": F.col("direct_reply_count") > 0, "large_time_span": F.lit(False) if cut is None else F.col("duration_seconds") >= cut,
    }


def review_sample(talks: DataFrame, threshold: int, seed: int = SEED) -> DataFrame:
    """(conversation_id, stratum): up to 50 conversations of a threshold, 7 of each stratum first."""
    some = talks.where(F.col("threshold") == threshold)
    return stratified(some, "conversation_id", review_strata(some), REVIEW_EACH, REVIEW_TOTAL, seed + threshold).select("conversation_id", "stratum")
