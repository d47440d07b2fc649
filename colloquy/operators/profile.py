"""Profiling of a message table: time, senders, replies, alternation of speakers, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import blank, phone_candidates, pii_flags, redact
from colloquy.operators.graph import parents
from colloquy.operators.ordered import with_previous, with_running_sum
from colloquy.sources.messages import TOPIC_MARK

#: Bounds in seconds of gaps between messages, and their names (fixed values). The bound before the last belongs below it.
GAP_BINS = [(60, "<1 minute"), (300, "1-5 minutes"), (600, "5-10 minutes"), (1800, "10-30 minutes"), (3600, "30-60 minutes")]
LONG_GAPS = (21600, "1-6 hours", ">6 hours")


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def local() -> Column:
    """The wall-clock time of the sender's offset."""
    return F.timestamp_seconds(F.unix_micros("ts") / F.lit(1e6) + F.coalesce(F.col("utc_offset_s"), F.lit(0)))


def described(value: Column, prefix: str = "") -> list[Column]:
    """Count, mean, median, p90, p95, least and greatest; quantiles interpolate at (n - 1) q."""
    at = lambda q: F.percentile(value, F.lit(q))
    return [F.count(value).alias(prefix + "count"), F.avg(value).alias(prefix + "mean"), at(0.5).alias(prefix + "median"), at(0.9).alias(prefix + "p90"), at(0.95).alias(prefix + "p95"), F.min(value).alias(prefix + "min"), F.max(value).alias(prefix + "max")]


def timed(messages: DataFrame) -> DataFrame:
    return messages.where("message_type = 'message' and ts is not null")


def gaps(messages: DataFrame) -> DataFrame:
    """(row_idx, gap): seconds since the message before, in row order; the first message has none."""
    some = timed(messages).select("row_idx", "ts")
    return with_previous(some, {"before": "ts"}).where("before is not null").select("row_idx", seconds(F.col("ts"), F.col("before")).alias("gap"))


def filled(counts: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """counts with a row for each of values; n is 0 where there was none."""
    return values.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gap_histogram(messages: DataFrame) -> DataFrame:
    """(bin, n) of all seven bins."""
    g, label = F.col("gap"), None
    for bound, name in GAP_BINS:
        label = F.when(g < bound, name) if label is None else label.when(g < bound, name)
    label = label.when(g <= LONG_GAPS[0], LONG_GAPS[1]).otherwise(LONG_GAPS[2])
    names = [n for _, n in GAP_BINS] + list(LONG_GAPS[1:])
    every = messages.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("bin"))
    return filled(gaps(messages).groupBy(label.alias("bin")).agg(F.count("*").alias("n")), "bin", every)


def gap_describe(messages: DataFrame) -> DataFrame:
    return gaps(messages).agg(*described(F.col("gap")), F.count_if(F.col("gap") == 0).alias("zero_gaps"), F.count_if(F.col("gap") < 0).alias("negative_gaps"))


def daily_counts(messages: DataFrame) -> DataFrame:
    """(day, n) of every calendar day from the first message to the last."""
    days = timed(messages).select(F.to_date(local()).alias("day"))
    every = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return filled(days.groupBy("day").agg(F.count("*").alias("n")), "day", every)


def hourly_counts(messages: DataFrame) -> DataFrame:
    """(hour, n) of all 24 hours."""
    hours = timed(messages).select(F.hour(local()).alias("hour")).groupBy("hour").agg(F.count("*").alias("n"))
    return filled(hours, "hour", messages.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")))


def service_counts(messages: DataFrame) -> DataFrame:
    return messages.where("message_type = 'service' and date_context is not null").groupBy("date_context").agg(F.count("*").alias("n"))


def has_attachment() -> Column:
    return (F.coalesce(F.size("attachments"), F.lit(0)) > 0) | F.col("attachment_type").isNotNull() | F.col("attachment_path").isNotNull()


def sender_stats(messages: DataFrame) -> DataFrame:
    normal = messages.where("message_type = 'message' and sender is not null")
    return normal.groupBy("sender").agg(F.count("*").alias("message_count"), F.count_if(~blank(F.col("text"))).alias("text_message_count"), F.count_if(has_attachment()).alias("attachment_message_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def sender_aliases(messages: DataFrame, width: int = 2) -> DataFrame:
    """(sender, alias): Sender 01, Sender 02 ... in the order of names; names are ranked, never gathered in one row."""
    names = messages.where("message_type = 'message' and sender is not null").select("sender").distinct()
    at = F.row_number().over(Window.orderBy("sender")).cast("string")
    return names.select("sender", F.concat(F.lit("Sender "), F.when(F.length(at) < width, F.lpad(at, width, "0")).otherwise(at)).alias("alias"))


def reply_target_types(messages: DataFrame) -> DataFrame:
    linked = parents(messages).where("message_type = 'message' and reply_to is not null")
    kind = F.when(F.col("parent_id").isNull(), "missing").when((F.col("parent_type") == "service") & F.col("parent_text").contains(TOPIC_MARK), "topic_creation_service").otherwise(F.col("parent_type"))
    return linked.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def top_reply_targets(messages: DataFrame, k: int = 20) -> DataFrame:
    """The k targets replied to most; of equals the one first replied to comes first."""
    r = messages.where("message_type = 'message' and reply_to is not null")
    n = r.groupBy(F.coalesce("reply_to_source_file", "source_file").alias("target_file"), F.col("reply_to").alias("target_id")).agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"))
    return n.orderBy(F.desc("n"), "first_row").limit(k)


def reply_root_groups(messages: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each root that messages go back to; found are the ancestors of messages."""
    rows = messages.where("message_type = 'message'").select("message_id", "sender", "ts").join(found, "message_id")
    groups = rows.groupBy("root_id").agg(F.count("*").alias("normal_message_count"), F.countDistinct("sender").alias("distinct_senders"), seconds(F.max("ts"), F.min("ts")).alias("span_seconds"), F.max("depth").alias("max_depth"))
    roots = messages.select(F.col("message_id").alias("root_id"), "message_type", "text")
    return groups.join(roots, "root_id", "left").select("root_id", F.coalesce("message_type", F.lit("missing")).alias("root_type"), F.coalesce(F.col("text").contains(TOPIC_MARK), F.lit(False)).alias("is_topic_creation"), "normal_message_count", "distinct_senders", "span_seconds", "max_depth")


def tumbling_activity(messages: DataFrame, found: DataFrame, minutes: int = 5) -> DataFrame:
    """One row: windows with a message, with three, with three senders, and of these with two reply roots."""
    rows = timed(messages).join(found.select("message_id", "root_id"), "message_id")
    w = rows.groupBy(F.window(local(), f"{minutes} minutes")).agg(F.count("*").alias("n"), F.countDistinct("sender").alias("s"), F.countDistinct("root_id").alias("r"))
    busy, multi = F.col("n") >= 3, (F.col("n") >= 3) & (F.col("s") >= 3)
    return w.agg(F.count("*").alias("active_windows"), F.count_if(busy).alias("busy_windows"), F.count_if(multi).alias("three_sender_windows"), F.count_if(multi & (F.col("r") >= 2)).alias("multi_root_windows"))


def sender_switches(messages: DataFrame) -> DataFrame:
    """One row: neighbouring pairs, and those whose senders differ."""
    pairs = with_previous(timed(messages).select("row_idx", "sender"), {"before": "sender"}).where("before is not null")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("sender") != F.col("before")).alias("switches"))


def global_switch_matrix(messages: DataFrame) -> DataFrame:
    """(from_sender, to_sender, n) of neighbouring messages of different senders."""
    pairs = with_previous(messages.where("message_type = 'message'").select("row_idx", "sender"), {"before": "sender"})
    return pairs.where("before <> sender").groupBy(F.col("before").alias("from_sender"), F.col("sender").alias("to_sender")).agg(F.count("*").alias("n"))


def aba_triples(messages: DataFrame, within: int = 600) -> DataFrame:
    """How often a sender speaks, another does, and the first again, within so many seconds."""
    once = with_previous(timed(messages).select("row_idx", "sender", "ts"), {"s1": "sender", "t1": "ts"})
    twice = with_previous(once, {"s2": "s1", "t2": "t1"})
    return twice.agg(F.count_if((F.col("s2") == F.col("sender")) & (F.col("s1") != F.col("sender")) & (seconds(F.col("ts"), F.col("t2")) <= within)).alias("aba_triples"))


def near_root_switches(messages: DataFrame, found: DataFrame, under: int = 300) -> DataFrame:
    """One row: neighbouring messages less than so many seconds apart, and those of different reply roots."""
    rows = timed(messages).select("message_id", "row_idx", "ts").join(found.select("message_id", "root_id"), "message_id")
    pairs = with_previous(rows, {"t1": "ts", "r1": "root_id"}).where((F.col("t1").isNotNull()) & (seconds(F.col("ts"), F.col("t1")) < under))
    return pairs.agg(F.count("*").alias("near_pairs"), F.count_if(F.col("root_id") != F.col("r1")).alias("root_switches"))


def same_sender_runs(messages: DataFrame) -> DataFrame:
    """(run, sender, length) of maximal runs of messages of one sender; service rows between do not end a run."""
    rows = with_previous(messages.where("message_type = 'message'").select("row_idx", "sender"), {"before": "sender"})
    numbered = with_running_sum(rows, F.when(F.col("before") == F.col("sender"), 0).otherwise(1), "run")
    return numbered.groupBy("run", "sender").agg(F.count("*").alias("length"))


def run_length_distribution(messages: DataFrame) -> DataFrame:
    return same_sender_runs(messages).groupBy("length").agg(F.count("*").alias("runs"))


def runs_by_sender(messages: DataFrame) -> DataFrame:
    return same_sender_runs(messages).groupBy("sender").agg(F.count("*").alias("runs"), F.max("length").alias("max_run_length"))


# Texts: of any table with a text column


def duplicate_texts(rows: DataFrame) -> DataFrame:
    """One row: distinct texts, groups of equal ones, their members, and occurrences beyond the first; blank texts do not count."""
    n = rows.where(~blank(F.col("text"))).groupBy("text").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("distinct_texts"), F.count_if(F.col("n") > 1).alias("repeated_text_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))


def top_texts(rows: DataFrame, order: str, k: int = 50) -> DataFrame:
    """The k texts that occur most, masked after ranking; of equals the first to occur comes first."""
    n = rows.where(~blank(F.col("text"))).groupBy("text").agg(F.count("*").alias("n"), F.min(order).alias("first_row"))
    top = n.orderBy(F.desc("n"), "first_row").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "first_row")).alias("rank"), redact(F.col("text"), "profile").alias("text_redacted"), "n", "first_row")


def text_length_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(*described(F.length("text").cast("double")), F.count_if(blank(F.col("text"))).alias("blank"))


def pii_counts(rows: DataFrame) -> DataFrame:
    """One row: texts with each kind of personal data, and with a URL, address or phone number."""
    flagged = rows.select(*[v.alias(k) for k, v in pii_flags(F.coalesce("text", F.lit(""))).items()])
    return flagged.agg(*[F.count_if(F.col(k)).alias(k) for k in flagged.columns], F.count_if(F.col("url") | F.col("email") | F.col("phone_candidate")).alias("url_email_or_phone"))


def phone_rows(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.size(phone_candidates(F.coalesce("text", F.lit("")))).cast("long").alias("n")).where("n > 0")
