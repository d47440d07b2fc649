"""Conversations of one message: how near their neighbours are, and what kind of single they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.graph import parents
from colloquy.operators.profile import filled, seconds
from colloquy.operators.sampling import SEED, stratified
from colloquy.operators.segmentation import topic_neighbours

CLASSES = ["STRUCTURALLY_ISOLATED", "POSSIBLE_PREVIOUS", "POSSIBLE_NEXT", "POSSIBLE_BOTH", "LONG_DISTANCE_REPLY", "UNKNOWN"]
#: Bounds in seconds of a single's gaps, and their names (fixed values); 7200 itself is in the bin before the last.
BINS = [(60, "<1 min"), (300, "1-5 min"), (600, "5-10 min"), (1800, "10-30 min"), (3600, "30-60 min")]


def singles(messages: DataFrame, found: DataFrame, members: DataFrame, threshold: int = 60) -> DataFrame:
    """A row for each single of a threshold with neighbours, relations and structural_classification.

    Relations say whether single and neighbour reply to each other or to one target; they are null without
    a neighbour. The first class that fits is given: a reply over a day, an unknown topic or lost target,
    then a close or replying neighbour before, after, or on both sides.
    """
    alone = members.where(F.col("threshold") == threshold).groupBy("conversation_id").agg(F.count("*").alias("size"), F.min("message_id").alias("message_id"), F.min("topic").alias("topic"))
    alone = alone.where("size = 1").drop("size")
    linked = parents(messages).select("message_id", "sender", "ts", "reply_to", "parent_id", "parent_type", "parent_ts")
    target = linked.select(F.col("message_id").alias("_of"), F.col("parent_id").alias("_target"))
    near = topic_neighbours(messages, found).select("message_id", "previous_id", "previous_sender", "gap_previous", "next_id", "next_sender", "gap_next")
    inbound = linked.where("parent_type = 'message' ").groupBy(F.col("parent_id").alias("message_id")).agg(F.count("*").alias("incoming"))
    rows = alone.join(linked, "message_id").join(near, "message_id", "left").join(inbound, "message_id", "left")
    for side in ("previous", "next"):
        other = target.select(F.col("_of").alias(f"{side}_id"), F.col("_target").alias(f"{side}_target"))
        rows = rows.join(other, f"{side}_id", "left")
        there = F.col(f"{side}_id").isNotNull()
        rows = rows.withColumns(
            {
                f"replies_to_{side}": F.when(there, F.coalesce(F.col("parent_id") == F.col(f"{side}_id"), F.lit(False))),
                f"{side}_replies": F.when(there, F.coalesce(F.col(f"{side}_target") == F.col("message_id"), F.lit(False))),
                f"same_target_{side}": F.when(there, F.coalesce(F.col("parent_id") == F.col(f"{side}_target"), F.lit(False))),
                f"same_sender_{side}": F.when(there, F.col("sender") == F.col(f"{side}_sender")),
            }
        ).withColumn(f"same_system_target_{side}", F.when(there, F.col(f"same_target_{side}") & F.coalesce(F.col("parent_type") == "service", F.lit(False))))
    reply_gap = F.when(F.col("parent_type") == "message", seconds(F.col("ts"), F.col("parent_ts")))
    close = lambda side: F.coalesce(F.col(f"gap_{side}") <= 3600, F.lit(False)) | F.coalesce(F.col(f"replies_to_{side}") | F.col(f"{side}_replies"), F.lit(False))
    label = (
        F.when(reply_gap > 86400, "LONG_DISTANCE_REPLY")
        .when(F.col("topic").isNull() | (F.col("reply_to").isNotNull() & F.col("parent_id").isNull()), "UNKNOWN")
        .when(close("previous") & close("next"), "POSSIBLE_BOTH")
        .when(close("previous"), "POSSIBLE_PREVIOUS")
        .when(close("next"), "POSSIBLE_NEXT")
        .otherwise("STRUCTURALLY_ISOLATED")
    )
    kind = F.when(F.col("reply_to").isNull(), "none").when(F.col("parent_id").isNull(), "missing").otherwise(F.col("parent_type"))
    return rows.withColumns({"structural_classification": label, "reply_target_gap_seconds": reply_gap, "reply_target_type": kind, "incoming": F.coalesce("incoming", F.lit(0)), "previous_sender_equals_next": F.col("previous_sender") == F.col("next_sender")}).drop("parent_ts", "previous_target", "next_target")


def _every(df: DataFrame, names: list[str], column: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias(column))


def class_counts(found: DataFrame) -> DataFrame:
    """(structural_classification, n, percent) of all six classes."""
    n = filled(found.groupBy("structural_classification").agg(F.count("*").alias("n")), "structural_classification", _every(found, CLASSES, "structural_classification"))
    total = found.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("structural_classification", "n", F.when(F.col("total") > 0, 100 * F.col("n") / F.col("total")).alias("percent"))


def gap_bin(g: Column) -> Column:
    label = F.when(g.isNull(), "no_neighbor")
    for bound, name in BINS:
        label = label.when(g < bound, name)
    return label.when(g <= 7200, "1-2 hr").otherwise(">2 hr")


def gap_bins(found: DataFrame) -> DataFrame:
    """(side, bin, n) of all bins of both sides."""
    long = found.select(F.explode(F.array(F.struct(F.lit("previous").alias("side"), gap_bin(F.col("gap_previous")).alias("bin")), F.struct(F.lit("next").alias("side"), gap_bin(F.col("gap_next")).alias("bin")))).alias("x")).select("x.*")
    every = _every(found, ["previous", "next"], "side").crossJoin(_every(found, [n for _, n in BINS] + ["1-2 hr", ">2 hr", "no_neighbor"], "bin"))
    return every.join(long.groupBy("side", "bin").agg(F.count("*").alias("n")), ["side", "bin"], "left").select("side", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def proximity(found: DataFrame, minutes: tuple[int, ...] = (5, 10, 30, 60)) -> DataFrame:
    """(minutes, previous_within, next_within, both_sides_within, either_side_within)."""
    m = _every(found, list(minutes), "minutes")
    p, n = (F.coalesce(F.col(f"gap_{s}") <= F.col("minutes") * 60, F.lit(False)) for s in ("previous", "next"))
    return m.join(found.select("gap_previous", "gap_next"), how="cross").groupBy("minutes").agg(F.count_if(p).alias("previous_within"), F.count_if(n).alias("next_within"), F.count_if(p & n).alias("both_sides_within"), F.count_if(p | n).alias("either_side_within"))


def continuity(found: DataFrame) -> DataFrame:
    """(field, equal_count, eligible_count, percent_among_eligible, percent_of_all) of the three sender comparisons."""
    fields = ("same_sender_previous", "same_sender_next", "previous_sender_equals_next")
    long = found.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("equal")) for f in fields])).alias("x")).select("x.*")
    e, n = F.count_if("equal"), F.count("equal")
    return long.groupBy("field").agg(e.alias("equal_count"), n.alias("eligible_count"), F.when(n > 0, 100 * e / n).alias("percent_among_eligible"), (100 * e / F.count("*")).alias("percent_of_all"))


def no_neighbour(found: DataFrame) -> DataFrame:
    """One row: singles without a neighbour before, after, on either side, and of these of unknown topic."""
    p, n = F.col("gap_previous").isNull(), F.col("gap_next").isNull()
    return found.agg(F.count_if(p).alias("no_previous"), F.count_if(n).alias("no_next"), F.count_if(p & n).alias("neither"), F.count_if(p & n & F.col("topic").isNull()).alias("neither_unknown_topic"))


def long_reply_stats(found: DataFrame, over: int = 86400) -> DataFrame:
    g = F.col("reply_target_gap_seconds")
    return found.where(g > over).agg(F.count("*").alias("n"), F.percentile(g, F.lit(0.5)).alias("median_seconds"), F.max(g).alias("max_seconds"))


#: Rows of each stratum, and rows in all, of the review sample (fixed values).
REVIEW_EACH, REVIEW_TOTAL = 12, 150


def review_sample(found: DataFrame, seed: int = SEED) -> DataFrame:
    """(message_id, stratum): one single of each topic, then up to 12 of each of ten strata, then others up to 150."""
    p, n = F.col("gap_previous"), F.col("gap_next")
    both = lambda s: F.coalesce((p < s) & (n < s), F.lit(False))
    strata = {
        "both_sides_under_5m": both(300), "both_sides_5_to_10m": both(600) & ~both(300), "both_sides_10_to_30m": both(1800) & ~both(600),
        "same_sender": F.coalesce("same_sender_previous", F.lit(False)) | F.coalesce("same_sender_next", F.lit(False)),
        "different_sender": F.coalesce(~F.col("same_sender_previous"), F.lit(False)) | F.coalesce(~F.col("same_sender_next"), F.lit(False)),
        "normal_direct_reply_related": (F.col("reply_target_type") == "message") | (F.col("incoming") > 0), "system_reply_reference_only": F.col("reply_target_type") == "service",
        "no_reply": F.col("reply_to").isNull(), "large_gap_over_24h": F.coalesce(p > 86400, F.lit(False)) | F.coalesce(n > 86400, F.lit(False)), "unknown_topic": F.col("topic").isNull(),
    }
    return stratified(found, "message_id", strata, REVIEW_EACH, REVIEW_TOTAL, seed, cover=("topic", None)).select("message_id", "stratum")


def overview(found: DataFrame) -> DataFrame:
    """One row: singles, those of known and unknown topic, reply targets by kind, and those tied to a neighbour by a reply."""
    kind = lambda k: F.count_if(F.col("reply_target_type") == k).alias(f"reply_target_{k}")
    tied = F.greatest(*[F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("replies_to_previous", "previous_replies", "replies_to_next", "next_replies")]) == 1
    known = F.col("topic").isNotNull()
    return found.agg(F.count("*").alias("singles"), F.count_if(known).alias("known_topic"), F.count_if(~known).alias("unknown_topic"), *[kind(k) for k in ("none", "missing", "service", "message")], F.count_if(tied).alias("direct_relationship_with_neighbour"), F.count_if(known & F.col("previous_id").isNull()).alias("first_of_topic"), F.count_if(known & F.col("next_id").isNull()).alias("last_of_topic"))


def long_distance(messages: DataFrame, found: DataFrame, members: DataFrame, over: int = 86400) -> DataFrame:
    """A row for each reply of an ordinary message to one over a day older: both ends, gap, topic, and their conversations."""
    linked = parents(messages).where("message_type = 'message' and parent_type = 'message'")
    gap = seconds(F.col("ts"), F.col("parent_ts"))
    some = linked.withColumn("gap_seconds", gap).where(F.col("gap_seconds") > over)
    where = members.select("message_id", "conversation_id")
    target = where.select(F.col("message_id").alias("parent_id"), F.col("conversation_id").alias("target_conversation_id"))
    full = some.join(where, "message_id").join(target, "parent_id").join(found.select("message_id", "topic"), "message_id")
    return full.select("message_id", "ts", "sender", "topic", "reply_to", F.col("parent_ts").alias("target_ts"), F.col("parent_sender").alias("target_sender"), "gap_seconds", (F.col("gap_seconds") / 3600).alias("gap_hours"), (F.col("gap_seconds") / 86400).alias("gap_days"), "conversation_id", "target_conversation_id", (F.col("conversation_id") == F.col("target_conversation_id")).alias("same_candidate"))
