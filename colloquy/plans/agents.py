"""Queries about agent messages, over the events read as a chat in which one sender is an agent and one a bot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import QUESTION_MARKERS
from colloquy.operators import audit, graph, roles
from colloquy.plans.base import A, m_roled, query, roled, shared
from colloquy.plans.stages import joined, micros

#: Texts that ask, texts with a question mark in a URL only, and the rest; the same rule in SQL.
_ASKED = "CASE WHEN row_idx % 7 = 0 THEN text || ' 請問?' WHEN row_idx % 11 = 0 THEN 'see https://example.org/?q=1 ' || text ELSE text END"
_CLEAN = r"regexp_replace(text, '(?i)(https?://|www\.)[^\s]+', '', 'g')"
_HITS = f"list_filter({QUESTION_MARKERS!r}, lambda x: contains({_CLEAN}, x))"
CTX = (
    A
    + f""",
rr AS (SELECT n.message_id, n.sender, n.ts, epoch_us(n.ts) AS us, CASE n.sender WHEN 'u0' THEN 'AGENT' WHEN 'u3' THEN 'BOT' ELSE 'USER' END AS role,
    {_ASKED.replace('row_idx', 'a.row_idx')} AS text, n.reply_to, a.row_idx, a.topic, CAST(component_row AS VARCHAR) AS component, component_size,
    coalesce('topic:' || a.topic, 'chain:' || CAST(component_row AS VARCHAR)) AS pool
  FROM n JOIN a USING (message_id) JOIN comp USING (head)),
rk AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY us, row_idx) AS rn FROM rr),
ag AS (SELECT * FROM rk WHERE role = 'AGENT'),
win AS (SELECT ag.message_id AS anchor, rk.message_id, rk.rn - ag.rn AS step FROM ag JOIN rk ON rk.pool = ag.pool AND rk.rn BETWEEN ag.rn - 10 AND ag.rn + 10
  WHERE abs(rk.us - ag.us) <= 3600000000),
ctx AS (SELECT anchor, message_id, bool_or(w) AS in_window, bool_or(NOT w) AS in_chain FROM (SELECT anchor, message_id, TRUE AS w FROM win
  UNION ALL SELECT ag.message_id, rr.message_id, FALSE FROM ag JOIN rr USING (component)) GROUP BY 1, 2),
side AS (SELECT ag.message_id, arg_max(b, b.rn) FILTER (b.rn < ag.rn) AS b, arg_min(b, b.rn) FILTER (b.rn > ag.rn) AS f
  FROM ag JOIN rk b ON b.pool = ag.pool AND b.role <> 'BOT' AND b.rn <> ag.rn GROUP BY 1),
mins(minutes) AS (VALUES (5), (10), (30), (60)),
follow AS (SELECT ag.message_id, minutes, count(l.message_id) FILTER (l.role <> 'AGENT') > 0 AS response,
    count(l.message_id) FILTER (l.sender <> ag.sender) > 0 AS other_human, count(l.message_id) FILTER (l.role <> 'AGENT' AND l.reply_to = ag.message_id) > 0 AS direct_reply,
    coalesce(string_agg(l.message_id, ',' ORDER BY l.rn) FILTER (l.role <> 'AGENT'), '') AS response_ids
  FROM ag CROSS JOIN mins LEFT JOIN rk l ON l.pool = ag.pool AND l.rn > ag.rn AND l.role <> 'BOT' AND l.us - ag.us <= minutes * CAST(60000000 AS BIGINT) GROUP BY 1, 2),
size AS (SELECT anchor AS message_id, count(*) AS normal_context_count, count(*) FILTER (NOT in_window) AS chain_extension_count FROM ctx GROUP BY 1),
answers AS (SELECT reply_to AS message_id, string_agg(message_id, ',' ORDER BY row_idx) AS ids FROM rr GROUP BY 1),
wide AS (SELECT message_id, {', '.join(f"bool_or(response) FILTER (minutes = {k}) AS response_within_{k}m, any_value(response_ids) FILTER (minutes = {k}) AS response_message_ids_{k}m, bool_or(other_human) FILTER (minutes = {k}) AS other_human_followup_within_{k}m, bool_or(direct_reply) FILTER (minutes = {k}) AS direct_nonagent_reply_within_{k}m" for k in audit.FOLLOW)}
  FROM follow GROUP BY 1),
feature AS (SELECT ag.message_id, ag.us, ag.sender, ag.role, ag.topic, ag.topic IS NULL AS topic_unknown, regexp_replace(ag.text, 'https://[^\\s<>]+', '[URL]') AS text, trim(ag.text) <> '' AS has_text,
    FALSE AS has_attachment, ag.reply_to, ag.reply_to IS NOT NULL AS has_reply_to, p.parent_id IS NOT NULL AS reply_target_resolved,
    CASE WHEN p.parent_service THEN 'service' WHEN p.parent_id IS NOT NULL THEN 'message' END AS reply_target_type, p.parent_sender AS reply_target_sender,
    CASE WHEN p.parent_id IS NOT NULL THEN coalesce(p.parent_sender = 'u0', FALSE) END AS reply_target_is_agent,
    CASE WHEN NOT p.parent_service THEN (ag.us - epoch_us(p.parent_ts)) / 1e6 END AS reply_target_gap_seconds, side.b.message_id AS previous_id, side.f.message_id AS next_id,
    side.b.sender AS previous_sender, side.f.sender AS next_sender, (ag.us - side.b.us) / 1e6 AS gap_previous, (side.f.us - ag.us) / 1e6 AS gap_next,
    len({_HITS.replace('text', 'ag.text')}) > 0 AS question_like, 'legacy_aggregate' AS question_text_scope, array_to_string({_HITS.replace('text', 'ag.text')}, ',') AS question_marker_hits,
    (SELECT count(*) FROM win WHERE anchor = ag.message_id AND step < 0) AS window_before_count, (SELECT count(*) FROM win WHERE anchor = ag.message_id AND step > 0) AS window_after_count,
    size.normal_context_count, size.chain_extension_count, size.normal_context_count = 1 AS no_normal_context, coalesce(answers.ids, '') AS incoming_direct_reply_ids, wide.* EXCLUDE (message_id)
  FROM ag JOIN p ON p.message_id = ag.message_id LEFT JOIN side ON side.message_id = ag.message_id JOIN size ON size.message_id = ag.message_id
    LEFT JOIN answers ON answers.message_id = ag.message_id JOIN wide ON wide.message_id = ag.message_id)
"""
)
EPISODE = (
    CTX
    + """,
linked AS (SELECT DISTINCT x.anchor AS x, y.anchor AS y FROM ctx x JOIN ctx y USING (message_id)),
reach AS (SELECT message_id AS x, message_id AS y FROM ag UNION SELECT reach.x, linked.y FROM reach JOIN linked ON linked.x = reach.y),
label AS (SELECT x AS anchor, min(row_idx) AS episode FROM reach JOIN ag ON message_id = y GROUP BY 1),
held AS (SELECT DISTINCT episode, message_id FROM ctx JOIN label USING (anchor)),
epi AS (SELECT episode, max(topic) AS topic, min(us) AS start_us, max(us) AS end_us, count(*) AS message_count, count(*) FILTER (role = 'AGENT') AS agent_message_count,
    coalesce(string_agg(DISTINCT sender, ',' ORDER BY sender) FILTER (role = 'AGENT'), '') AS agent_senders, coalesce(string_agg(DISTINCT sender, ',' ORDER BY sender) FILTER (role = 'USER'), '') AS other_senders,
    coalesce(string_agg(DISTINCT sender, ',' ORDER BY sender) FILTER (role = 'BOT'), '') AS bot_senders, string_agg(message_id, ',' ORDER BY message_id) FILTER (role = 'AGENT') AS agent_anchor_ids,
    count(*) FILTER (role = 'AGENT' AND len("""
    + _HITS
    + """) > 0) AS question_like_agent_count
  FROM held JOIN rr USING (message_id) GROUP BY 1)
"""
)


def chat(s, d) -> DataFrame:
    """m_roled with texts that ask, by the rule of _ASKED."""
    return m_roled(s, d).withColumn("text", F.when(F.col("message_type") == "message", F.expr(_ASKED)).otherwise(F.col("text")))


@shared
def _c(s, d):
    msgs = chat(s, d)
    found = graph.persisted(graph.ancestors(msgs))
    return msgs, found, graph.persisted(audit.pooled(msgs, found))


@shared
def _episodes(s, d):
    msgs, found, rows = _c(s, d)
    return msgs, rows, graph.persisted(audit.episodes(rows)), found


def _ids(side: str):
    return F.array_join(F.transform(side, lambda x: x["message_id"]), ",")


query(
    "participant_sets",
    A
    + """, rr AS (SELECT coalesce('topic:' || topic, 'chain:' || component_row) AS pool, sender, CASE sender WHEN 'u0' THEN 'AGENT' WHEN 'u3' THEN 'BOT' ELSE 'USER' END AS role FROM a JOIN comp USING (head))
SELECT pool AS conversation_id, string_agg(DISTINCT sender, ',' ORDER BY sender) AS humans, coalesce(string_agg(DISTINCT sender, ',' ORDER BY sender) FILTER (role = 'AGENT'), '') AS agents,
  coalesce(string_agg(DISTINCT sender, ',' ORDER BY sender) FILTER (role = 'USER'), '') AS others FROM rr WHERE role <> 'BOT' GROUP BY 1""",
)(lambda s, d: (lambda x: roles.participant_sets(x[0], x[2].select(F.col("pool").alias("conversation_id"), "message_id")).withColumns(joined("humans", "agents", "others")))(_c(s, d)))
query(
    "agent_context_window",
    CTX
    + """SELECT ag.message_id, coalesce(string_agg(win.message_id, ',' ORDER BY step) FILTER (step < 0), '') AS before_ids, coalesce(string_agg(win.message_id, ',' ORDER BY step) FILTER (step > 0), '') AS after_ids
FROM ag JOIN win ON anchor = ag.message_id GROUP BY 1""",
)(lambda s, d: audit.windows(_c(s, d)[2]).select("message_id", _ids("before").alias("before_ids"), _ids("after").alias("after_ids")))
query("agent_context", CTX + "SELECT anchor, message_id, in_window, in_chain FROM ctx")(lambda s, d: audit.context(_c(s, d)[2]))
query("next_non_bot", CTX + "SELECT message_id, previous_id, previous_sender, gap_previous, next_id, next_sender, gap_next FROM feature")(lambda s, d: audit.neighbours(_c(s, d)[2]))
query("followup_within", CTX + "SELECT message_id, minutes, response, other_human, direct_reply, response_ids FROM follow")(
    lambda s, d: (lambda x: audit.followups(x[2], graph.parents(x[0])).withColumns(joined("response_ids")))(_c(s, d))
)
_LISTS = ["question_marker_hits", "incoming_direct_reply_ids", *[f"response_message_ids_{k}m" for k in audit.FOLLOW]]
query("agent_features", CTX + "SELECT * FROM feature")(lambda s, d: (lambda x: audit.features(x[0], x[1]).withColumns(joined(*_LISTS) | micros(us="ts")).drop("ts"))(_c(s, d)))
_PEOPLE = ["agent_senders", "other_senders", "bot_senders"]
query("agent_episodes", EPISODE + "SELECT * FROM epi")(
    lambda s, d: (lambda x: audit.episode_table(x[1], x[2]).withColumns(joined(*_PEOPLE, "agent_anchor_ids") | micros(start_us="start_ts", end_us="end_ts")).drop("start_ts", "end_ts"))(_episodes(s, d))
)
query(
    "agent_episode_provenance",
    EPISODE
    + """SELECT episode, ctx.message_id, anchor, (x.us - y.us) / 1e6 AS gap_seconds, abs(x.us - y.us) > 3600000000 AS outside_60m,
  CASE WHEN ctx.message_id = anchor THEN 'agent_anchor' WHEN in_window AND in_chain THEN 'same_topic_time_window,resolved_direct_reply_component'
    WHEN in_window THEN 'same_topic_time_window' ELSE 'resolved_direct_reply_component' END AS reasons
FROM ctx JOIN label USING (anchor) JOIN rr x ON x.message_id = ctx.message_id JOIN rr y ON y.message_id = anchor""",
)(lambda s, d: (lambda x: audit.provenance(x[1], x[2]).withColumns(joined("reasons")))(_episodes(s, d)))
query(
    "agent_episode_system_references",
    EPISODE + "SELECT DISTINCT episode, p.parent_id AS message_id FROM label JOIN rr x ON x.message_id = anchor JOIN rr y ON y.component = x.component JOIN p ON p.message_id = y.message_id WHERE p.parent_service",
)(lambda s, d: (lambda x: audit.system_references(x[0], x[1], x[2]))(_episodes(s, d)))
query(
    "agent_episode_annotation",
    EPISODE + "SELECT episode, topic, start_us, end_us, message_count, agent_message_count, agent_senders, other_senders, question_like_agent_count, " + ", ".join(f"'' AS {c}" for c in audit.MANUAL) + " FROM epi",
)(
    lambda s, d: (lambda x: audit.annotation(audit.episode_table(x[1], x[2])).withColumns(joined("agent_senders", "other_senders") | micros(start_us="start_ts", end_us="end_ts")).drop("start_ts", "end_ts"))(_episodes(s, d))
)


@query(
    "agent_episode_overlaps",
    EPISODE
    + """, planted AS (SELECT episode, message_id FROM held UNION ALL SELECT episode + 1000000, message_id FROM held WHERE CAST(message_id AS BIGINT) % 29 = 0
  UNION ALL SELECT episode, '1' FROM held WHERE episode % 13 = 0)
SELECT 'message' AS kind, message_id AS id, count(DISTINCT episode) AS n FROM planted GROUP BY 2 HAVING count(DISTINCT episode) > 1
UNION ALL SELECT 'episode', CAST(episode AS VARCHAR), count(DISTINCT coalesce(topic, '')) FROM planted JOIN rr USING (message_id) GROUP BY 2 HAVING count(DISTINCT coalesce(topic, '')) > 1""",
)
def _overlaps(s, d):
    """The check on members with faults: some messages in a second episode, and one message in many episodes."""
    _, rows, labels, _ = _episodes(s, d)
    members = graph.persisted(audit.episode_members(rows, labels))
    twice = members.where(F.col("message_id").cast("long") % 29 == 0).withColumn("episode", F.col("episode") + 1_000_000)
    stray = members.where("episode % 13 = 0").select("episode", F.lit("1").alias("message_id"))
    return audit.overlaps(members.union(twice).union(stray).join(rows.select("message_id", "topic"), "message_id"))


@query("agent_episode_faults", EPISODE + "SELECT 'message' AS kind, message_id AS id, count(*) AS n FROM held GROUP BY 2 HAVING count(*) > 1")
def _no_overlaps(s, d):
    """The check on the real members: no rows."""
    _, rows, labels, _ = _episodes(s, d)
    return audit.overlaps(audit.episode_members(rows, labels).join(rows.select("message_id", "topic"), "message_id"))


query(
    "agent_stats",
    CTX
    + """SELECT minutes, q.asked AS questions_only, count(*) FILTER (response) AS response, count(*) FILTER (direct_reply) AS direct_reply, count(*) FILTER (other_human) AS other_human
FROM follow JOIN feature USING (message_id) CROSS JOIN (VALUES (FALSE), (TRUE)) q(asked) WHERE question_like OR NOT q.asked GROUP BY 1, 2""",
)(lambda s, d: (lambda x: audit.agent_stats(audit.features(x[0], x[1]), audit.followups(x[2], graph.parents(x[0]))))(_c(s, d)))


def _statistics_sql() -> str:
    one = lambda name, value, table="feature": f"SELECT '{name}' AS figure, '' AS key, CAST({value} AS DOUBLE) AS value FROM {table}"
    each = lambda name, key: f"SELECT '{name}', {key}, CAST(count(*) AS DOUBLE) FROM feature GROUP BY 2"
    rows = [
        one("agent_message_count", "count(*)"), one("known_agent_topic_count", "count(DISTINCT topic)"), one("unknown_topic_agent_count", "count(*) FILTER (topic_unknown)"),
        one("question_like_agent_count", "count(*) FILTER (question_like)"), one("agent_has_reply_to_count", "count(*) FILTER (has_reply_to)"), one("chain_extension_message_occurrences", "sum(chain_extension_count)"),
    ]
    for k in audit.FOLLOW:
        for name, c in (("nonagent_later_message", f"response_within_{k}m"), ("explicit_nonagent_direct_reply", f"direct_nonagent_reply_within_{k}m"), ("other_human_later_message", f"other_human_followup_within_{k}m")):
            rows += [one(f"all_{name}_{k}m", f"count(*) FILTER ({c})"), one(f"question_like_{name}_{k}m", f"count(*) FILTER ({c} AND question_like)")]
    rows += [
        one("episode_count", "count(*)", "epi"), one("episode_message_count_median", "quantile_cont(message_count, 0.5)", "epi"), one("episode_message_count_p90", "quantile_cont(message_count, 0.9)", "epi"),
        one("episode_message_count_max", "max(message_count)", "epi"), one("single_agent_message_episodes", "count(*) FILTER (agent_message_count = 1)", "epi"), one("unique_normal_messages_in_episodes", "sum(message_count)", "epi"),
        each("agent_sender_counts", "sender"), each("agent_date_counts", "CAST(CAST(make_timestamp(us) AS DATE) AS VARCHAR)"), each("agent_topic_counts", "coalesce(topic, 'None')"),
        each("agent_reply_target_counts", "CASE WHEN reply_target_resolved THEN reply_target_type WHEN has_reply_to THEN 'missing' ELSE 'none' END"),
        "SELECT 'agent_messages_without_normal_context', message_id, 1.0 FROM feature WHERE no_normal_context",
        "SELECT 'agent_messages_without_time_window_neighbors', message_id, 1.0 FROM feature WHERE window_before_count + window_after_count = 0",
    ]
    return EPISODE + "\nUNION ALL ".join(rows)


@query("agent_statistics", _statistics_sql())
def _statistics(s, d):
    msgs, rows, labels, found = _episodes(s, d)
    return audit.statistics(graph.persisted(audit.features(msgs, found)), graph.persisted(audit.episode_table(rows, labels)))


@query("agent_context_of_conversations")
def _in_conversations(s, d):
    """The windows of agent messages in the conversations table, whose roles come from a mapping."""
    msgs = roled(s, d)
    return audit.windows(audit.pooled(msgs, graph.ancestors(msgs))).select("message_id", _ids("before").alias("before_ids"), _ids("after").alias("after_ids"))
