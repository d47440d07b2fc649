"""Streaming forms of two batch reports. They are extensions: the batch operators are the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_activity(messages: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Messages and (approximate) senders of each window; a window closes once the watermark passes it."""
    timed = messages.where("message_type = 'message' and ts is not null").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{minutes} minutes")).agg(F.count("*").alias("messages"), F.approx_count_distinct("sender").alias("senders")).select(F.col("window.start").alias("start"), "messages", "senders")


def sender_sessions(messages: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of each sender's messages with no pause longer than gap."""
    timed = messages.where("message_type = 'message' and ts is not null").withWatermark("ts", late)
    return timed.groupBy("sender", F.session_window("ts", gap)).agg(F.count("*").alias("messages")).select("sender", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "messages")
