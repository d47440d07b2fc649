"""Behaviour of senders: profiles, who replies to and follows whom, and the table of roles that people fill in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import blank, question_mark, redact, template
from colloquy.operators.graph import parents
from colloquy.operators.ordered import in_time, nearest
from colloquy.operators.profile import global_switch_matrix, has_attachment, local, seconds
from colloquy.operators.sampling import SEED, stratified

ROLES = ("", "USER", "AGENT", "INTERNAL", "BOT", "UNKNOWN")


def reply_matrix(messages: DataFrame) -> DataFrame:
    """(from_sender, to_sender, n): replies of ordinary messages to ordinary messages."""
    linked = parents(messages).where("message_type = 'message' and parent_type = 'message'")
    return linked.groupBy(F.col("sender").alias("from_sender"), F.col("parent_sender").alias("to_sender")).agg(F.count("*").alias("n"))


def adjacency_matrix(messages: DataFrame, found: DataFrame, within: int = 600) -> DataFrame:
    """(from_sender, to_sender, n): neighbours in a known topic at most so many seconds apart."""
    rows = messages.select("message_id", "sender", "ts").join(found.where("topic is not null").select("message_id", "row_idx", "topic"), "message_id")
    pairs = nearest(rows, F.struct("sender", "ts"), "before", ["topic"], in_time()).where("before is not null")
    close = pairs.where(seconds(F.col("ts"), F.col("before.ts")) <= within)
    return close.groupBy(F.col("before.sender").alias("from_sender"), F.col("sender").alias("to_sender")).agg(F.count("*").alias("n"))


def dense_matrix(pairs: DataFrame, senders: list[str]) -> DataFrame:
    """A row and a column for each sender, zeros included; for writing, since senders are few."""
    wide = pairs.groupBy("from_sender").pivot("to_sender", senders).agg(F.first("n"))
    every = pairs.sparkSession.createDataFrame([(s,) for s in senders], "from_sender string")
    return every.join(wide, "from_sender", "left").fillna(0).withColumnRenamed("from_sender", "sender")


def partners(pairs: DataFrame, direction: str = "out") -> DataFrame:
    """(sender, partners): others by falling count, equals by name; direction out, in, or both (counts of the two added)."""
    out = pairs.select(F.col("from_sender").alias("sender"), F.col("to_sender").alias("other"), "n")
    back = pairs.select(F.col("to_sender").alias("sender"), F.col("from_sender").alias("other"), "n")
    some = {"out": out, "in": back, "both": out.unionByName(back)}[direction].where("sender <> other and n > 0").groupBy("sender", "other").agg(F.sum("n").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("other").alias("sender"), F.col("n").alias("count"))))
    return some.groupBy("sender").agg(F.transform(ranked, lambda x: F.struct(x["sender"].alias("sender"), x["count"].alias("count"))).alias("partners"))


def sender_profiles(messages: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each sender: counts, times, replies sent and received, text lengths, ratios, ranked partners."""
    linked = parents(messages).where("message_type = 'message'").join(found.select("message_id", "topic"), "message_id", "left")
    text, replied = ~blank(F.col("text")), F.col("reply_to").isNotNull()
    url, n = F.col("text").rlike(r"(?i)(?:https?://|www\.)"), F.length("text").cast("double")
    attached = (F.coalesce(F.size("attachments"), F.lit(0)) > 0) | F.col("attachment_type").isNotNull()
    wide = linked.groupBy("sender").agg(
        F.count("*").alias("message_count"), F.count_if(text).alias("text_message_count"), F.count_if(attached).alias("attachment_message_count"), F.sum(F.greatest(F.coalesce(F.size("attachments"), F.lit(0)), F.lit(0))).alias("attachment_item_count"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct(F.to_date(local())).alias("active_days"),
        F.count_if(replied).alias("reply_sent_count"), F.count_if(F.col("parent_type") == "message").alias("reply_sent_to_normal_count"), F.count_if(F.col("parent_type") == "service").alias("reply_sent_to_system_count"),
        F.count_if(replied & F.col("parent_id").isNull()).alias("reply_sent_unresolved_count"), F.count_if((F.col("parent_type") == "message") & (F.col("parent_sender") == F.col("sender"))).alias("self_reply_count"),
        F.avg(n).alias("mean_text_length_including_empty"), F.percentile(n, F.lit(0.5)).alias("median_text_length_including_empty"), F.avg(F.when(text, n)).alias("mean_nonempty_text_length"), F.percentile(F.when(text, n), F.lit(0.5)).alias("median_nonempty_text_length"),
        F.count_if(url).alias("url_message_count"), (F.count_if(url) / F.count("*")).alias("url_message_ratio"), (F.count_if(attached) / F.count("*")).alias("attachment_message_ratio"),
        F.count_if(question_mark(F.col("text"))).alias("question_mark_message_count"), F.countDistinct("topic").alias("known_topic_count"),
    )
    replies, near, switches = reply_matrix(messages), adjacency_matrix(messages, found), global_switch_matrix(messages)
    received = replies.groupBy(F.col("to_sender").alias("sender")).agg(F.sum("n").alias("reply_received_count"))
    own = near.where("from_sender = to_sender").select(F.col("from_sender").alias("sender"), F.col("n").alias("same_sender_topic_adjacency_count"))
    out = wide.join(received, "sender", "left").join(own, "sender", "left").fillna(0, ["reply_received_count", "same_sender_topic_adjacency_count"])
    named = {"most_replied_to": (replies, "out"), "most_replied_by": (replies, "in"), "reply_interactions_other_senders": (replies, "both"), "adjacency_interactions_other_senders": (near, "both"), "same_topic_switches_to": (near, "out"), "same_topic_switches_from": (near, "in"), "global_switches_to": (switches, "out"), "global_switches_from": (switches, "in")}
    for name, (pairs, way) in named.items():
        out = out.join(partners(pairs, way).withColumnRenamed("partners", name), "sender", "left")
    return out


def described(value: Column) -> list[Column]:
    """Count, mean, median, least, greatest, and spread against the mean (null unless that is above 0)."""
    return [F.count(value).alias("count"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.when(F.avg(value) > 0, F.stddev_pop(value) / F.avg(value)).alias("coefficient_of_variation")]


def interarrival(messages: DataFrame, sender: str) -> DataFrame:
    """One row about the seconds between a sender's messages, and how many are at most 60."""
    own = messages.where((F.col("message_type") == "message") & (F.col("sender") == sender)).select("row_idx", "sender", "ts")
    gap = own.select(seconds(F.col("ts"), F.lag("ts").over(Window.partitionBy("sender").orderBy("row_idx"))).alias("gap"))
    return gap.agg(*described(F.col("gap")), F.count_if(F.col("gap") <= 60).alias("within_60_seconds"))


def evidence(messages: DataFrame, sender: str) -> DataFrame:
    """One row about a sender's texts: repeats, templates, prefixes, lines, fields. It says nothing about a role."""
    own = messages.where((F.col("message_type") == "message") & (F.col("sender") == sender)).withColumn("template", template(F.col("text")))
    t = F.regexp_replace(F.col("text"), r"^[\s　]+", "")
    flags = own.agg(F.count("*").alias("message_count"), F.countDistinct("text").alias("distinct_exact_texts"), F.countDistinct("template").alias("normalized_template_count"), F.count_if(t.startswith("✅")).alias("checkmark_prefix_count"), F.count_if(t.rlike("^[❌⚠❗]")).alias("warning_or_failure_prefix_count"), F.count_if(F.col("text").contains("\n")).alias("multiline_count"), F.count_if(F.col("text").rlike("(?m)^.{1,24}[:：]")).alias("colon_field_candidate_count"))
    n = own.groupBy("text").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("exact_duplicate_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("messages_in_exact_duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_occurrences_beyond_first"))
    return flags.crossJoin(n)


def top_values(messages: DataFrame, sender: str, what: str, k: int) -> DataFrame:
    """(value, n, first_row) of a sender's k most frequent texts (masked), templates or send times; of equals the first to occur."""
    value = {"text": F.col("text"), "template": template(F.col("text")), "time": F.date_format(local(), "HH:mm:ss")}[what]
    own = messages.where((F.col("message_type") == "message") & (F.col("sender") == sender)).groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"))
    top = own.orderBy(F.desc("n"), "first_row").limit(k)
    return top.withColumn("value", redact(F.col("value"), "roles")) if what == "text" else top


def mapping_template(messages: DataFrame) -> DataFrame:
    """(sender, role, confidence, notes) with blank roles, a row for each sender."""
    e = F.lit("")
    return messages.where("message_type = 'message'").select("sender").distinct().select("sender", e.alias("role"), e.alias("confidence"), e.alias("notes"))


def kept_mapping(messages: DataFrame, existing: DataFrame) -> DataFrame:
    """existing as people filled it in; ValueError if its senders are not those of messages, or a role is not one of ROLES."""
    wanted = mapping_template(messages).select("sender")
    have = existing.select("sender")
    if have.count() != have.distinct().count() or not wanted.exceptAll(have.distinct()).isEmpty() or not have.exceptAll(wanted).isEmpty():
        raise ValueError("the mapping's senders differ from those of the messages")
    if not existing.where(~F.coalesce("role", F.lit("")).isin(*ROLES)).isEmpty():
        raise ValueError("the mapping has an unknown role")
    return existing


def with_roles(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """messages with role: SYSTEM_EVENT for service rows, else the sender's; ValueError if one has none or two.

    roles has a row for each sender; Spark broadcasts it where its size allows.
    """
    if not roles.groupBy("sender").count().where("count > 1").isEmpty():
        raise ValueError("a sender has two roles")
    from colloquy.operators.checks import unmapped_senders

    if not unmapped_senders(messages, roles).isEmpty():
        raise ValueError("a sender has no role, and none is guessed")
    named = roles.select(F.col("sender").alias("_sender"), F.col("role").alias("_role"))
    return messages.join(named, F.col("sender") == F.col("_sender"), "left").withColumn("role", F.when(F.col("message_type") == "message", F.col("_role")).otherwise("SYSTEM_EVENT")).drop("_sender", "_role")


def role_counts(roled: DataFrame) -> DataFrame:
    return roled.groupBy("role").agg(F.count("*").alias("messages"), F.countDistinct("sender").alias("senders"))


def participant_sets(roled: DataFrame, members: DataFrame) -> DataFrame:
    """(conversation_id, humans, agents, others): sorted names of those who are no bot, of agents, and of the rest."""
    who = members.select("conversation_id", "message_id").join(roled.where("message_type = 'message' and role <> 'BOT'").select("message_id", "sender", "role"), "message_id")
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("sender"))))
    return who.groupBy("conversation_id").agg(F.array_sort(F.collect_set("sender")).alias("humans"), pick(F.col("role") == "AGENT").alias("agents"), pick(F.col("role") != "AGENT").alias("others"))


def hours(messages: DataFrame, sender: str) -> DataFrame:
    """(hour, n): when a sender writes, by the wall clock; hours without a message are left out."""
    own = messages.where((F.col("message_type") == "message") & (F.col("sender") == sender))
    return own.groupBy(F.hour(local()).alias("hour")).agg(F.count("*").alias("n"))


#: Days, rows of each stratum, and rows in all that a sender's sample has (fixed values).
REVIEW_DAYS, REVIEW_EACH, REVIEW_TOTAL = 8, 3, 30


def review_sample(messages: DataFrame, found: DataFrame, seed: int = SEED) -> DataFrame:
    """(sender, message_id, stratum): up to 30 texts of each sender: one of each of 8 days, then 3 of each stratum, then others."""
    linked = parents(messages)
    own = linked.where("message_type = 'message'").where(~blank(F.col("text")))
    mine = messages.select("message_id", has_attachment().alias("attached"))
    answered = linked.where("message_type = 'message' and parent_type = 'message' and sender <> parent_sender").select(F.col("parent_id").alias("message_id")).distinct().withColumn("answered", F.lit(True))
    beside = messages.select("message_id", "ts").join(found.where("topic is not null").select("message_id", "row_idx", "topic"), "message_id").join(mine, "message_id")
    near = nearest(nearest(beside, F.struct("attached"), "_p", ["topic"], in_time()), F.struct("attached"), "_n", ["topic"], in_time(), later=True)
    around = near.select("message_id", (F.coalesce("_p.attached", F.lit(False)) | F.coalesce("_n.attached", F.lit(False))).alias("beside"))
    target = mine.select(F.col("message_id").alias("parent_id"), F.col("attached").alias("target_attached"))
    rows = own.join(answered, "message_id", "left").join(around, "message_id", "left").join(mine, "message_id").join(target, "parent_id", "left").withColumn("day", F.to_date(local()))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = F.length("text")
    strata = {
        "question_mark": question_mark(F.col("text")), "reply_to_other_sender": (F.col("parent_type") == "message") & (F.col("parent_sender") != F.col("sender")), "replied_by_other_sender": no("answered"),
        "attachment_context": no("attached") | no("beside") | no("target_attached"), "long_100plus_chars": n >= 100, "short_20or_fewer_chars": n <= 20,
    }
    return stratified(rows, "message_id", strata, REVIEW_EACH, REVIEW_TOTAL, seed, by=["sender"], cover=("day", REVIEW_DAYS)).select("sender", "message_id", "stratum")
