"""Integrity of a message table: each check returns the rows that break it, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import blank
from colloquy.operators.ordered import with_previous


def duplicate_ids(messages: DataFrame) -> DataFrame:
    """(message_id, n) of ids that stand more than once."""
    return messages.groupBy("message_id").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_keys(messages: DataFrame) -> DataFrame:
    return messages.groupBy("source_file", "message_id").agg(F.count("*").alias("n")).where("n > 1")


def missing_reply_targets(messages: DataFrame) -> DataFrame:
    """(source_file, message_id, target_source_file, target_id, scope): outer replies, and replies of forwarded parts, to what is not there."""
    outer = messages.where("reply_to is not null").select("source_file", "message_id", F.coalesce("reply_to_source_file", "source_file").alias("target_source_file"), F.col("reply_to").alias("target_id"), F.lit("reply").alias("scope"))
    inner = messages.select("source_file", "message_id", F.explode("forwarded").alias("f")).where("f.reply is not null").select("source_file", "message_id", F.coalesce("f.reply.source_file", "source_file").alias("target_source_file"), F.col("f.reply.message_id").alias("target_id"), F.lit("forwarded_reply").alias("scope"))
    there = messages.select(F.col("source_file").alias("target_source_file"), F.col("message_id").alias("target_id"))
    return outer.unionByName(inner).join(there, ["target_source_file", "target_id"], "left_anti").select("source_file", "message_id", "target_source_file", "target_id", "scope")


def chronology_violations(messages: DataFrame) -> DataFrame:
    """(message_id, ts, previous_ts) of ordinary messages older than the one before them."""
    normal = messages.where("message_type = 'message' and ts is not null").select("row_idx", "message_id", "ts")
    return with_previous(normal, {"previous_ts": "ts"}).where("ts < previous_ts").select("message_id", "ts", "previous_ts")


def offsets(messages: DataFrame) -> DataFrame:
    """(utc_offset_s, n); more than one row is a fault."""
    return messages.where("ts is not null").groupBy("utc_offset_s").agg(F.count("*").alias("n"))


def empty_messages(messages: DataFrame) -> DataFrame:
    """Ordinary messages without text and attachment."""
    return messages.where((F.col("message_type") == "message") & blank(F.col("text")) & (F.coalesce(F.size("attachments"), F.lit(0)) <= 0)).select("source_file", "message_id")


def unmapped_senders(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """(sender) of ordinary messages without a role, or with a blank one."""
    return messages.where("message_type = 'message'").select("sender").distinct().join(roles.where(~blank(F.col("role"))).select("sender"), "sender", "left_anti")


def broken_replies(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Direct replies whose two ends are in different conversations."""
    a = membership.select(F.col("message_id").alias("parent"), F.col("conversation_id").alias("a"))
    b = membership.select(F.col("message_id").alias("child"), F.col("conversation_id").alias("b"))
    return edges.join(a, "parent").join(b, "child").where("a <> b")


def incomplete_partition(messages: DataFrame, membership: DataFrame) -> DataFrame:
    """(message_id, n) of messages that are not in exactly one conversation, and of members that are no message."""
    counts = membership.groupBy("message_id").agg(F.count("*").alias("n"))
    return messages.select("message_id", F.lit(1).alias("known")).join(counts, "message_id", "full").where("known is null or n is null or n <> 1").select("message_id", F.coalesce("n", F.lit(0)).alias("n"))


def summary(messages: DataFrame) -> DataFrame:
    """One row of counts: records, ordinary and service rows, texts, attachments, senders."""
    normal, text = F.col("message_type") == "message", ~blank(F.col("text"))
    attached = F.coalesce(F.size("attachments"), F.lit(0)) > 0
    return messages.agg(F.count("*").alias("total_records"), F.count_if(normal).alias("normal_messages"), F.count_if(~normal).alias("service_messages"), F.count_if(text).alias("text_records_including_service"), F.count_if(normal & text).alias("normal_text_messages"), F.count_if(normal & ~text & attached).alias("attachment_only_messages"), F.countDistinct(F.when(normal, F.col("sender"))).alias("distinct_sender_names"))


def attachment_types(messages: DataFrame) -> DataFrame:
    return messages.where("message_type = 'message'").select(F.explode("attachments.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
