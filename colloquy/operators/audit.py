"""Agent messages: their context, what follows them, and episodes of agent messages that share context.

A message's pool is its topic, or its reply component where the topic is unknown: never others of unknown
topic that happen to be near in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import blank, question_hits, redact
from colloquy.operators.graph import parents, persisted
from colloquy.operators.ordered import in_time, nearest
from colloquy.operators.profile import seconds

REACH, SPAN, FOLLOW = 10, 3600, (5, 10, 30, 60)
#: Columns of the annotation table that people fill in (fixed values).
MANUAL = ["customer_service_interaction", "agent_behavior", "information_missing_before", "agent_asked_missing_information", "information_provided_after", "potential_missing_information", "notes"]


def pooled(roled: DataFrame, found: DataFrame) -> DataFrame:
    """Ordinary messages with role, topic, component and pool."""
    rows = roled.where("message_type = 'message'").select("message_id", "sender", "ts", "role", "text", "own_text", "reply_to", "attachments", "attachment_type").join(found.select("message_id", "row_idx", "topic", "component", "component_size"), "message_id")
    return rows.withColumn("pool", F.coalesce(F.concat(F.lit("topic:"), "topic"), F.concat(F.lit("chain:"), "component")))


def windows(rows: DataFrame) -> DataFrame:
    """A row for each agent message with before and after: up to REACH messages of its pool on each side within SPAN seconds.

    Neighbours count by position in (time, row) order, so messages of the same second stay on their side. Pools
    are cut into spans of time; a row shows up in its own span and in both beside it, so no window is wider.
    """
    slot = F.floor(F.unix_seconds("ts") / SPAN)
    spread = rows.withColumn("_slot", slot).withColumn("_cut", F.explode(F.array(F.col("_slot") - 1, F.col("_slot"), F.col("_slot") + 1)))
    w = Window.partitionBy("pool", "_cut").orderBy("ts", "row_idx")
    near = F.struct("message_id", "ts", "sender", "role", "row_idx", "component")
    sides = spread.withColumns({"b": F.collect_list(near).over(w.rowsBetween(-REACH, -1)), "a": F.collect_list(near).over(w.rowsBetween(1, REACH))})
    sides = sides.where("role = 'AGENT' and _slot = _cut").drop("_slot", "_cut")
    within = lambda side, sign: F.filter(side, lambda x: sign * (F.unix_micros(x["ts"]) - F.unix_micros("ts")) <= SPAN * 1_000_000)
    return sides.withColumns({"before": within("b", -1), "after": within("a", 1)}).drop("a", "b")


def neighbours(rows: DataFrame) -> DataFrame:
    """(message_id, previous_id, previous_sender, gap_previous, next_id, next_sender, gap_next) of agent messages: the nearest messages of the pool that are no bot's."""
    who = F.when(F.col("role") != "BOT", F.struct("message_id", "sender", "ts"))
    brief = rows.select("message_id", "sender", "ts", "row_idx", "role", "pool")
    sides = nearest(nearest(brief, who, "p", ["pool"], in_time()), who, "n", ["pool"], in_time(), later=True).where("role = 'AGENT'")
    return sides.select(
        "message_id", F.col("p.message_id").alias("previous_id"), F.col("p.sender").alias("previous_sender"), seconds(F.col("ts"), F.col("p.ts")).alias("gap_previous"),
        F.col("n.message_id").alias("next_id"), F.col("n.sender").alias("next_sender"), seconds(F.col("n.ts"), F.col("ts")).alias("gap_next"),
    )


def followups(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """(message_id, minutes, response, other_human, direct_reply, response_ids) of agent messages.

    Later means later in the pool's order. response: a later message of one who is neither agent nor bot;
    other_human: of anyone else but a bot; direct_reply: one that replies to the message, by a non-agent.
    """
    agents = rows.where("role = 'AGENT'").select("message_id", "ts", "row_idx", "sender", "pool")
    later = rows.select(F.col("message_id").alias("l_id"), F.col("ts").alias("l_ts"), F.col("row_idx").alias("l_row"), F.col("sender").alias("l_sender"), F.col("role").alias("l_role"), "pool")
    # cut into spans of time, so that a message meets only those of its own span and the next
    span = max(FOLLOW) * 60
    a = agents.withColumn("cut", F.explode(F.array(F.floor(F.unix_seconds("ts") / span), F.floor(F.unix_seconds("ts") / span) + 1)))
    b = later.withColumn("cut", F.floor(F.unix_seconds("l_ts") / span))
    gap = seconds(F.col("l_ts"), F.col("ts"))
    met = a.join(b, ["pool", "cut"]).where((F.struct("l_ts", "l_row") > F.struct("ts", "row_idx")) & (gap >= 0) & (gap <= span) & (F.col("l_role") != "BOT"))
    direct = linked.where("message_type = 'message' and parent_type = 'message'").select(F.col("message_id").alias("d_id"), F.col("parent_id").alias("d_parent"))
    met = met.join(direct, (F.col("l_id") == F.col("d_id")) & (F.col("message_id") == F.col("d_parent")), "left")
    plain = F.col("l_role") != "AGENT"
    figures = []
    for m in FOLLOW:
        near = gap <= m * 60
        figures += [F.count_if(near & plain).alias(f"r{m}"), F.count_if(near & (F.col("l_sender") != F.col("sender"))).alias(f"o{m}"), F.count_if(near & plain & F.col("d_id").isNotNull() & (F.col("l_row") > F.col("row_idx"))).alias(f"d{m}"), F.array_sort(F.collect_list(F.when(near & plain, F.struct("l_ts", "l_row", "l_id")))).alias(f"i{m}")]
    rolled = agents.select("message_id").join(met.groupBy("message_id").agg(*figures), "message_id", "left")
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["l_id"]), F.array().cast("array<string>"))
    return rolled.select("message_id", F.explode(F.array(*[F.struct(F.lit(m).alias("minutes"), some(f"r{m}").alias("response"), some(f"o{m}").alias("other_human"), some(f"d{m}").alias("direct_reply"), ids(f"i{m}").alias("response_ids")) for m in FOLLOW])).alias("x")).select("message_id", "x.*")


def features(roled: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each agent message: text, reply target, neighbours, question markers, size of its context, what follows."""
    rows = persisted(pooled(roled, found))
    linked = parents(roled)
    target = linked.select("message_id", "parent_id", "parent_type", "parent_sender", "parent_ts")
    role_of = roled.where("message_type = 'message'").select(F.col("sender").alias("parent_sender"), F.col("role").alias("parent_role")).distinct()
    direct = linked.where("message_type = 'message' and parent_type = 'message'").groupBy(F.col("parent_id").alias("message_id"))
    replies = direct.agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.col("message_id").alias("id")))), lambda x: x["id"]).alias("incoming_direct_reply_ids"))
    around = windows(rows)
    base = around.join(target, "message_id", "left").join(role_of, "parent_sender", "left").join(neighbours(rows), "message_id").join(replies, "message_id", "left")
    # of the window's messages, those of the own reply component are in the context anyway
    same = F.size(F.filter(F.concat("before", "after"), lambda x: x["component"] == F.col("component")))
    window = F.size("before") + F.size("after")
    follow = followups(rows, linked).groupBy("message_id").pivot("minutes", list(FOLLOW)).agg(F.first("response").alias("r"), F.first("response_ids").alias("i"), F.first("other_human").alias("o"), F.first("direct_reply").alias("d"))
    later = [F.col(f"{m}_{c}").alias(f"{name}{m}m") for m in FOLLOW for c, name in (("r", "response_within_"), ("i", "response_message_ids_"), ("o", "other_human_followup_within_"), ("d", "direct_nonagent_reply_within_"))]
    hits = question_hits(F.coalesce("own_text", "text"))
    resolved = F.col("parent_id").isNotNull()
    return base.join(follow, "message_id").withColumns({"normal_context_count": window + F.col("component_size") - same, "chain_extension_count": F.col("component_size") - same - 1}).select(
        "message_id", "ts", "sender", "role", "topic", F.col("topic").isNull().alias("topic_unknown"), redact(F.col("text"), "roles").alias("text"), (~blank(F.col("text"))).alias("has_text"),
        ((F.coalesce(F.size("attachments"), F.lit(0)) > 0) | F.col("attachment_type").isNotNull()).alias("has_attachment"), "reply_to", F.col("reply_to").isNotNull().alias("has_reply_to"),
        resolved.alias("reply_target_resolved"), F.col("parent_type").alias("reply_target_type"), F.col("parent_sender").alias("reply_target_sender"),
        F.when(resolved, F.coalesce(F.col("parent_role") == "AGENT", F.lit(False))).alias("reply_target_is_agent"),
        F.when(F.col("parent_type") == "message", seconds(F.col("ts"), F.col("parent_ts"))).alias("reply_target_gap_seconds"),
        "previous_id", "next_id", "previous_sender", "next_sender", "gap_previous", "gap_next", (F.size(hits) > 0).alias("question_like"),
        F.when(F.col("own_text").isNotNull(), "own_text").otherwise("legacy_aggregate").alias("question_text_scope"), hits.alias("question_marker_hits"),
        F.size("before").alias("window_before_count"), F.size("after").alias("window_after_count"), F.col("normal_context_count").cast("long").alias("normal_context_count"),
        F.col("chain_extension_count").cast("long").alias("chain_extension_count"), (F.col("normal_context_count") == 1).alias("no_normal_context"),
        F.coalesce("incoming_direct_reply_ids", F.array().cast("array<string>")).alias("incoming_direct_reply_ids"), *later,
    )


def in_windows(rows: DataFrame) -> DataFrame:
    """(anchor, message_id): the messages of each agent message's window, itself included; 21 at most."""
    ids = lambda side: F.transform(side, lambda x: x["message_id"])
    return windows(rows).select(F.col("message_id").alias("anchor"), F.explode(F.concat(ids("before"), ids("after"), F.array("message_id"))).alias("message_id"))


def context(rows: DataFrame) -> DataFrame:
    """(anchor, message_id, in_window, in_chain): the messages of each agent message's window and reply component, itself included.

    This lists a component once for each of its agent messages; only a report that wants that list should ask for it.
    """
    chain = rows.where("role = 'AGENT'").select(F.col("message_id").alias("anchor"), "component").join(rows.select("message_id", "component"), "component").select("anchor", "message_id")
    both = in_windows(rows).withColumn("w", F.lit(1)).unionByName(chain.withColumn("c", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("anchor", "message_id").agg(F.max("w").isNotNull().alias("in_window"), F.max("c").isNotNull().alias("in_chain"))


def episodes(rows: DataFrame) -> DataFrame:
    """(anchor, episode): agent messages whose contexts share a message, joined as far as that goes; episode is the earliest anchor's row.

    Anchors on one side, reply components and window messages (as their components) on the other are a bipartite
    graph: a component is one node however many anchors and messages it has, since contexts hold it whole, and
    a window message belongs to the contexts of all that share it. Labels fall to the smallest around until none
    changes. Components and windows lie within a topic, so a label crosses none.
    """
    order = rows.where("role = 'AGENT'").select(F.col("message_id").alias("anchor"), F.col("row_idx").alias("episode"))
    own = rows.where("role = 'AGENT'").select(F.col("message_id").alias("anchor"), F.concat(F.lit("c"), "component").alias("node"))
    held = rows.where("role = 'AGENT'").select("component").distinct().withColumn("held", F.lit(True))
    near = in_windows(rows).join(rows.select("message_id", "component"), "message_id").join(held, "component", "left")
    # a window message of a component with agent messages is in those agents' contexts as well
    shared = near.select("anchor", F.when(F.col("held"), F.concat(F.lit("c"), "component")).otherwise(F.concat(F.lit("m"), "message_id")).alias("node"))
    pairs = persisted(own.union(shared).distinct())
    labels = order
    while True:
        low = pairs.join(labels, "anchor").groupBy("node").agg(F.min("episode").alias("low"))
        around = pairs.join(low, "node").groupBy("anchor").agg(F.min("low").alias("near"))
        # a label is the row of an anchor: take that anchor's label as well
        via = labels.join(order.withColumnRenamed("episode", "row"), "anchor").select(F.col("row").alias("near"), F.col("episode").alias("hop"))
        moved = persisted(labels.join(around, "anchor").join(via, "near", "left").select("anchor", F.least("near", F.coalesce("hop", "near"), "episode").alias("new"), "episode"))
        labels = moved.select("anchor", F.col("new").alias("episode"))
        if moved.where("new <> episode").isEmpty():
            return labels


def episode_members(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (episode, message_id): windows, and each reply component once for its episode."""
    chains = labels.join(rows.select(F.col("message_id").alias("anchor"), "component"), "anchor").select("episode", "component").distinct()
    whole = chains.join(rows.select("message_id", "component"), "component").select("episode", "message_id")
    return in_windows(rows).join(labels, "anchor").select("episode", "message_id").union(whole).distinct()


def episode_table(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each episode: topic, times, counts, senders by role, anchors."""
    facts = rows.select("message_id", "ts", "row_idx", "sender", "role", "topic", F.size(question_hits(F.coalesce("own_text", "text"))).alias("hits"))
    members = episode_members(rows, labels).join(facts, "message_id")
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("sender"))))
    agent = F.col("role") == "AGENT"
    return members.groupBy("episode").agg(
        F.max("topic").alias("topic"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("message_count"), F.count_if(agent).alias("agent_message_count"), pick(agent).alias("agent_senders"),
        pick(~F.col("role").isin("AGENT", "BOT")).alias("other_senders"), pick(F.col("role") == "BOT").alias("bot_senders"), F.array_sort(F.collect_list(F.when(agent, F.col("message_id")))).alias("agent_anchor_ids"), F.count_if(agent & (F.col("hits") > 0)).alias("question_like_agent_count"),
    )


def provenance(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(episode, message_id, anchor, gap_seconds, outside_60m, reasons): why each message is in its episode."""
    at = rows.select("message_id", "ts")
    c = context(rows).join(labels, "anchor").join(at, "message_id").join(at.select(F.col("message_id").alias("anchor"), F.col("ts").alias("anchor_ts")), "anchor")
    own = F.col("message_id") == F.col("anchor")
    why = F.array_compact(F.array(F.when(own, "agent_anchor"), F.when(F.col("in_window") & ~own, "same_topic_time_window"), F.when(F.col("in_chain") & ~own, "resolved_direct_reply_component")))
    gap = seconds(F.col("ts"), F.col("anchor_ts"))
    return c.select("episode", "message_id", "anchor", gap.alias("gap_seconds"), (F.abs(gap) > 3600).alias("outside_60m"), why.alias("reasons"))


def system_references(roled: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(episode, message_id): service rows that the reply chains of an episode's anchors go to; they join no episodes."""
    refs = parents(roled).where("message_type = 'message' and parent_type = 'service'").select("message_id", "parent_id")
    chains = rows.select("message_id", "component").join(refs, "message_id").select("component", "parent_id")
    return labels.join(rows.select(F.col("message_id").alias("anchor"), "component"), "anchor").join(chains, "component").select("episode", F.col("parent_id").alias("message_id")).distinct()


def overlaps(members: DataFrame) -> DataFrame:
    """Messages in two episodes, or episodes of two topics; none in a right result. members has episode, message_id, topic."""
    twice = members.groupBy("message_id").agg(F.countDistinct("episode").alias("n")).where("n > 1").select(F.lit("message").alias("kind"), F.col("message_id").alias("id"), "n")
    topics = members.groupBy("episode").agg(F.countDistinct(F.coalesce("topic", F.lit(""))).alias("n")).where("n > 1")
    return twice.unionByName(topics.select(F.lit("episode").alias("kind"), F.col("episode").cast("string").alias("id"), "n"))


def annotation(table: DataFrame) -> DataFrame:
    """The episode table with a blank column for each of MANUAL."""
    return table.select("episode", "topic", "start_ts", "end_ts", "message_count", "agent_message_count", "agent_senders", "other_senders", "question_like_agent_count", *[F.lit("").alias(c) for c in MANUAL])


def statistics(made: DataFrame, table: DataFrame) -> DataFrame:
    """(figure, key, value): all figures about agent messages (made, of `features`) and episodes (table, of `episode_table`)."""
    rows = lambda df, name, key, n=None: df.select(F.lit(name).alias("figure"), key.cast("string").alias("key"), (n if n is not None else F.col("n")).cast("double").alias("value"))
    counted = lambda name, key: rows(made.groupBy(key.alias("k")).agg(F.count("*").alias("n")), name, F.coalesce(F.col("k").cast("string"), F.lit("None")))
    kind = F.when(F.col("reply_target_resolved"), F.col("reply_target_type")).when(F.col("has_reply_to"), "missing").otherwise("none")
    lonely = F.col("window_before_count") + F.col("window_after_count") == 0
    total = {
        "agent_message_count": F.count("*"), "known_agent_topic_count": F.countDistinct("topic"), "unknown_topic_agent_count": F.count_if("topic_unknown"), "question_like_agent_count": F.count_if("question_like"),
        "agent_has_reply_to_count": F.count_if("has_reply_to"), "chain_extension_message_occurrences": F.coalesce(F.sum("chain_extension_count"), F.lit(0)),
    }
    for m in FOLLOW:
        for name, c in (("nonagent_later_message", f"response_within_{m}m"), ("explicit_nonagent_direct_reply", f"direct_nonagent_reply_within_{m}m"), ("other_human_later_message", f"other_human_followup_within_{m}m")):
            total |= {f"all_{name}_{m}m": F.count_if(c), f"question_like_{name}_{m}m": F.count_if(F.col(c) & F.col("question_like"))}
    n = F.col("message_count")
    of_episodes = {
        "episode_count": F.count("*"), "episode_message_count_median": F.percentile(n, F.lit(0.5)), "episode_message_count_p90": F.percentile(n, F.lit(0.9)), "episode_message_count_max": F.max(n),
        "single_agent_message_episodes": F.count_if(F.col("agent_message_count") == 1), "unique_normal_messages_in_episodes": F.coalesce(F.sum(n), F.lit(0)),
    }

    def unpivoted(df: DataFrame, figures: dict) -> DataFrame:
        wide = df.agg(*[v.cast("double").alias(k) for k, v in figures.items()])
        return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.lit("").alias("key"), F.col(k).alias("value")) for k in figures])).alias("x")).select("x.*")

    return (
        unpivoted(made, total).unionByName(unpivoted(table, of_episodes)).unionByName(counted("agent_sender_counts", F.col("sender"))).unionByName(counted("agent_date_counts", F.to_date("ts")))
        .unionByName(counted("agent_topic_counts", F.col("topic"))).unionByName(counted("agent_reply_target_counts", kind))
        .unionByName(rows(made.where("no_normal_context"), "agent_messages_without_normal_context", F.col("message_id"), F.lit(1)))
        .unionByName(rows(made.where(lonely), "agent_messages_without_time_window_neighbors", F.col("message_id"), F.lit(1)))
    )


def agent_stats(made: DataFrame, follow: DataFrame) -> DataFrame:
    """(minutes, questions_only, response, direct_reply, other_human): how many agent messages are followed so."""
    q = follow.join(made.select("message_id", "question_like"), "message_id")
    count = lambda df, flag: df.groupBy("minutes").agg(F.lit(flag).alias("questions_only"), *[F.count_if(c).alias(c) for c in ("response", "direct_reply", "other_human")])
    every = follow.select("minutes").distinct().withColumn("questions_only", F.lit(True))
    return count(q, False).unionByName(every.join(count(q.where("question_like"), True).drop("questions_only"), "minutes", "left").fillna(0))
