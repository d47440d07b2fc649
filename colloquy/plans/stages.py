"""Queries of the later stages (segmentation, singles, role-aware joining, agent messages), each with its SQL.

Arrays come as text joined by commas and times as microseconds, so that both sides print alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import checks, graph, reconstruct, sampling, segmentation, singles
from colloquy.plans import derived_sql as ds
from colloquy.plans.base import A, M_ROLES, m, m_roled, query, shared

SEG, ONE = ds.segments(A), ds.singles(A)
PLACED = ds.placed(A, "CASE sender WHEN 'u0' THEN 'AGENT' WHEN 'u3' THEN 'BOT' ELSE 'USER' END")
assert M_ROLES == {"u0": "AGENT", "u1": "USER", "u2": "USER", "u3": "BOT"}


def joined(*names: str) -> dict[str, Column]:
    return {n: F.array_join(n, ",") for n in names}


def micros(**names: str) -> dict[str, Column]:
    return {new: F.unix_micros(old) for new, old in names.items()}


# Segmentation


@shared
def _segments(s: SparkSession, d: str):
    msgs = m(s, d)
    found = graph.persisted(graph.ancestors(msgs))
    decided = graph.persisted(segmentation.merged(segmentation.weak_proposals(msgs, found)))
    return msgs, found, decided, segmentation.membership(msgs, found, decided)


@shared
def _talks(s: SparkSession, d: str):
    msgs, found, decided, members = _segments(s, d)
    members = graph.persisted(members)
    return msgs, found, decided, members, segmentation.conversations(msgs, members, graph.direct_edges(graph.parents(msgs)))


query(
    "segmentation_membership",
    SEG
    + """SELECT threshold, conversation_id, message_id, row_idx, topic, component, 'chat' AS candidate_type FROM member
UNION ALL SELECT t, 'context_' || t || 'm_' || message_id, message_id, row_idx, NULL, NULL, 'system_event' FROM m, thr WHERE service""",
)(lambda s, d: segmentation.with_system_events(m(s, d), _segments(s, d)[3]))
query("segmentation_conversations", SEG + "SELECT * FROM talk")(
    lambda s, d: _talks(s, d)[4].withColumns(joined("components") | micros(start_us="start_ts", end_us="end_ts")).drop("start_ts", "end_ts")
)
query(
    "segmentation_decisions",
    SEG
    + """SELECT cut.t AS threshold, cut.topic, walk.kind, prop.x AS a, prop.y AS b, prop.gap
FROM cut JOIN walk ON walk.topic = cut.topic AND walk.k <= cut.k JOIN prop ON prop.topic = walk.topic AND prop.k = walk.k WHERE walk.kind <> 'same'""",
)(lambda s, d: _segments(s, d)[2].where("kind <> 'member'").select("threshold", "topic", "kind", "a", "b", "gap"))
query(
    "segmentation_stability",
    SEG
    + """, sized AS (SELECT threshold, message_id, count(*) OVER (PARTITION BY threshold, conversation_id) AS size FROM member),
step AS (SELECT threshold, lead(threshold) OVER w AS next_threshold, size = lead(size) OVER w AS same FROM sized WINDOW w AS (PARTITION BY message_id ORDER BY threshold)),
per AS (SELECT threshold, count(*) AS n FROM talk GROUP BY 1)
SELECT step.threshold, next_threshold, count(*) AS messages, count(*) FILTER (same) AS unchanged, count(*) FILTER (NOT same) AS changed,
  100.0 * count(*) FILTER (same) / count(*) AS unchanged_percent, any_value(y.n - x.n) AS conversation_count_change
FROM step JOIN per x ON x.threshold = step.threshold JOIN per y ON y.threshold = next_threshold WHERE next_threshold IS NOT NULL GROUP BY 1, 2""",
)(lambda s, d: segmentation.stability(_segments(s, d)[3]))
query("segmentation_sender_counts", SEG + "SELECT threshold, sender_count, count(*) AS n FROM talk GROUP BY 1, 2")(lambda s, d: segmentation.sender_count_distribution(_talks(s, d)[4]))


@query(
    "segmentation_comparison",
    SEG
    + """, links AS (SELECT cut.t AS threshold, count(*) FILTER (kind = 'accepted') AS accepted, count(*) FILTER (kind = 'blocked') AS blocked
  FROM cut JOIN walk ON walk.topic = cut.topic AND walk.k <= cut.k GROUP BY 1),
broken AS (SELECT x.threshold, count(*) FILTER (x.conversation_id <> y.conversation_id) AS broken FROM edge JOIN member x ON x.message_id = child
  JOIN member y ON y.message_id = parent AND y.threshold = x.threshold GROUP BY 1),
held AS (SELECT threshold, conversation_id, count(DISTINCT member.topic) AS topics, count(DISTINCT CASE WHEN component_size > 1 THEN component END) AS trees
  FROM member JOIN comp ON CAST(component_row AS VARCHAR) = component GROUP BY 1, 2),
faults AS (SELECT threshold, count(*) FILTER (topics > 1) AS multi, count(*) FILTER (trees > 1) AS trees FROM held GROUP BY 1)
SELECT threshold, count(*) AS conversations, avg(message_count) AS message_count_mean, quantile_cont(message_count, 0.5) AS message_count_median,
  quantile_cont(message_count, 0.9) AS message_count_p90, max(message_count) AS message_count_max, avg(duration_seconds) AS duration_seconds_mean,
  quantile_cont(duration_seconds, 0.5) AS duration_seconds_median, quantile_cont(duration_seconds, 0.9) AS duration_seconds_p90,
  max(duration_seconds) AS duration_seconds_max, count(*) FILTER (message_count = 1) AS single_message_count,
  100.0 * count(*) FILTER (message_count = 1) / count(*) AS single_message_percent, count(*) FILTER (message_count > 20) AS over_20_messages,
  count(*) FILTER (message_count > 50) AS over_50_messages, count(*) FILTER (message_count > 100) AS over_100_messages,
  CAST(sum(direct_reply_count) AS BIGINT) AS direct_replies, CAST(sum(long_replies) AS BIGINT) AS direct_reply_edges_over_threshold,
  count(*) FILTER (max_internal_gap_seconds > threshold * 60) AS conversations_with_gap_over_threshold,
  any_value(accepted) AS accepted_weak_links, any_value(blocked) AS blocked_weak_links, any_value(broken) AS broken_direct_reply_count,
  any_value(multi) AS multi_topic_conversations, any_value(faults.trees) AS conversations_merging_multiple_nontrivial_reply_chains,
  (SELECT count(*) FROM m WHERE service) AS system_event_records, (SELECT count(*) FROM edge) AS resolved_normal_direct_reply_count,
  (SELECT count(*) FROM p WHERE parent_service) AS topic_or_service_links,
  (SELECT count(*) FROM p WHERE reply_to IS NOT NULL AND parent_id IS NULL) AS unresolved_direct_reply_count,
  count(*) + (SELECT count(*) FROM m WHERE service) AS total_output_records
FROM talk JOIN links USING (threshold) JOIN broken USING (threshold) JOIN faults USING (threshold) GROUP BY threshold""",
)
def _comparison(s, d):
    msgs, found, decided, members, talks = _talks(s, d)
    return segmentation.comparison(talks, decided, members, graph.parents(msgs), found)


def _planted(members: DataFrame) -> DataFrame:
    """The conversations of 60 minutes with faults: every 23rd row is moved away, every 31st is lost, every 37th stands twice."""
    own = F.concat(F.lit("moved_"), "message_id")
    some = members.where("threshold = 60 and row_idx % 31 <> 0").withColumn("conversation_id", F.when(F.col("row_idx") % 23 == 0, own).otherwise(F.col("conversation_id")))
    return some.unionByName(some.where("row_idx % 37 = 0"))


@query(
    "segmentation_broken_replies",
    SEG
    + """, planted AS (SELECT message_id, row_idx, CASE WHEN row_idx % 23 = 0 THEN 'moved_' || message_id ELSE conversation_id END AS cid
  FROM member WHERE threshold = 60 AND row_idx % 31 <> 0)
SELECT DISTINCT parent, child, gap AS gap_seconds, x.cid AS a, y.cid AS b FROM edge JOIN planted x ON x.message_id = parent
  JOIN planted y ON y.message_id = child WHERE x.cid <> y.cid""",
)
def _broken(s, d):
    msgs, _, _, members = _segments(s, d)
    return checks.broken_replies(graph.direct_edges(graph.parents(msgs)), _planted(members)).distinct()


@query(
    "segmentation_incomplete",
    "WITH e AS (SELECT event_id AS i FROM events) SELECT CAST(i AS VARCHAR) AS message_id, CASE WHEN i % 31 = 0 THEN 0 ELSE 2 END AS n FROM e WHERE i % 40 <> 0 AND (i % 31 = 0 OR i % 37 = 0)",
)
def _incomplete(s, d):
    msgs, _, _, members = _segments(s, d)
    return checks.incomplete_partition(msgs.where("message_type = 'message'"), _planted(members))


@query("segmentation_faults", SEG + "SELECT x.threshold, child AS message_id, 'broken' AS fault FROM edge JOIN member x ON x.message_id = child JOIN member y ON y.message_id = parent AND y.threshold = x.threshold WHERE x.conversation_id <> y.conversation_id UNION ALL SELECT threshold, message_id, 'count' FROM member GROUP BY 1, 2 HAVING count(*) <> 1")
def _no_faults(s, d):
    """The two checks on the real conversations of every threshold: no rows."""
    msgs, _, _, members = _segments(s, d)
    members, edges, out = graph.persisted(members), graph.direct_edges(graph.parents(msgs)), None
    for t in segmentation.THRESHOLDS:
        own = members.where(F.col("threshold") == t)
        broken = checks.broken_replies(edges, own).select(F.lit(t).alias("threshold"), F.col("child").alias("message_id"), F.lit("broken").alias("fault"))
        lost = checks.incomplete_partition(msgs.where("message_type = 'message'"), own).select(F.lit(t).alias("threshold"), "message_id", F.lit("count").alias("fault"))
        out = broken.unionByName(lost) if out is None else out.unionByName(broken).unionByName(lost)
    return out


def picks_sql(source: str, key: str, strata: dict[str, str], each: int, total: int, seed: int, by: str | None = None, cover: str | None = None, order: list[str] | None = None) -> str:
    """Tables that pick a stratified sample of source one stratum after the other; the last is picks. cover is SQL for (k, b) that come first."""
    rank = f"md5('{seed}:' || CAST({key} AS VARCHAR))"
    b = by or "1"
    out = f"ranked AS (SELECT *, CAST({key} AS VARCHAR) AS k_, CAST({b} AS VARCHAR) AS b_, {rank} AS h_ FROM {source}),\nt0 AS ({cover or 'SELECT CAST(NULL AS VARCHAR) AS k_, CAST(NULL AS VARCHAR) AS b_, CAST(NULL AS VARCHAR) AS stratum WHERE FALSE'})"
    last = "t0"
    for i, name in enumerate([*(order or strata), "rest"], 1):
        flag, most = (strata[name], f"least({each}, {total} - used)") if name != "rest" else ("TRUE", f"{total} - used")
        out += f""",
s{i} AS (SELECT k_, b_ FROM (SELECT r.k_, r.b_, row_number() OVER (PARTITION BY r.b_ ORDER BY r.h_, r.k_) AS n_, coalesce(u.used, 0) AS used
    FROM (SELECT * FROM ranked WHERE ({flag}) AND k_ NOT IN (SELECT k_ FROM {last} WHERE k_ IS NOT NULL)) r
    LEFT JOIN (SELECT b_, count(*) AS used FROM {last} GROUP BY 1) u ON u.b_ = r.b_) WHERE n_ <= {most}),
t{i} AS (SELECT * FROM {last} UNION ALL SELECT k_, b_, '{name}' FROM s{i})"""
        last = f"t{i}"
    return out + f",\npicks AS (SELECT k_, b_, stratum FROM {last})\n"


query(
    "segmentation_review_sample",
    SEG
    + ", pool AS (SELECT *, duration_seconds >= (SELECT quantile_cont(duration_seconds, 0.9) FROM talk WHERE threshold = 60 AND duration_seconds > 0) AS long_span FROM talk WHERE threshold = 60),\n"
    + picks_sql(
        "pool", "conversation_id",
        {"short_1_2_messages": "message_count <= 2", "medium_3_10_messages": "message_count BETWEEN 3 AND 10", "long_11plus_messages": "message_count >= 11", "multi_sender": "sender_count >= 2", "direct_reply": "direct_reply_count > 0", "large_time_span": "long_span"},
        7, 50, sampling.SEED + 60,
    )
    + "SELECT k_ AS conversation_id, stratum FROM picks",
)(lambda s, d: segmentation.review_sample(graph.persisted(_talks(s, d)[4]), 60))

# Conversations of one message


@shared
def _singles(s, d):
    msgs, found, _, members = _segments(s, d)
    return graph.persisted(singles.singles(msgs, found, members))


_FLAGS = [f"{a}{x}" for x in ("previous", "next") for a in ("replies_to_", "same_target_", "same_sender_", "same_system_target_")] + ["previous_replies", "next_replies", "previous_sender_equals_next"]
_SINGLE = ["conversation_id", "message_id", "topic", "structural_classification", "previous_id", "next_id", "gap_previous", "gap_next", "reply_target_type", "reply_target_gap_seconds", "incoming", *_FLAGS]
query("singleton_classification", ONE + f"SELECT {', '.join(_SINGLE)} FROM single")(lambda s, d: _singles(s, d).select(*_SINGLE))
query(
    "singleton_class_counts",
    ONE + f"SELECT x.c AS structural_classification, count(message_id) AS n, 100.0 * count(message_id) / (SELECT count(*) FROM single) AS percent FROM (SELECT unnest({singles.CLASSES!r}) AS c) x LEFT JOIN single ON structural_classification = x.c GROUP BY 1",
)(lambda s, d: singles.class_counts(_singles(s, d)))
_BIN = "CASE WHEN {0} IS NULL THEN 'no_neighbor' WHEN {0} < 60 THEN '<1 min' WHEN {0} < 300 THEN '1-5 min' WHEN {0} < 600 THEN '5-10 min' WHEN {0} < 1800 THEN '10-30 min' WHEN {0} < 3600 THEN '30-60 min' WHEN {0} <= 7200 THEN '1-2 hr' ELSE '>2 hr' END"
query(
    "singleton_gap_bins",
    ONE
    + f""", b AS (SELECT 'previous' AS side, {_BIN.format('gap_previous')} AS bin FROM single UNION ALL SELECT 'next', {_BIN.format('gap_next')} FROM single)
SELECT s.side, l.bin, count(b.bin) AS n FROM (VALUES ('previous'), ('next')) s(side)
CROSS JOIN (VALUES ('<1 min'), ('1-5 min'), ('5-10 min'), ('10-30 min'), ('30-60 min'), ('1-2 hr'), ('>2 hr'), ('no_neighbor')) l(bin)
LEFT JOIN b ON b.side = s.side AND b.bin = l.bin GROUP BY 1, 2""",
)(lambda s, d: singles.gap_bins(_singles(s, d)))
query(
    "singleton_proximity",
    ONE
    + """SELECT minutes, count(*) FILTER (gap_previous <= minutes * 60) AS previous_within, count(*) FILTER (gap_next <= minutes * 60) AS next_within,
  count(*) FILTER (gap_previous <= minutes * 60 AND gap_next <= minutes * 60) AS both_sides_within,
  count(*) FILTER (gap_previous <= minutes * 60 OR gap_next <= minutes * 60) AS either_side_within
FROM single CROSS JOIN (VALUES (5), (10), (30), (60)) v(minutes) GROUP BY 1""",
)(lambda s, d: singles.proximity(_singles(s, d)))
query(
    "singleton_continuity",
    ONE
    + """SELECT field, count(*) FILTER (equal) AS equal_count, count(equal) AS eligible_count,
  CASE WHEN count(equal) > 0 THEN 100.0 * count(*) FILTER (equal) / count(equal) END AS percent_among_eligible, 100.0 * count(*) FILTER (equal) / count(*) AS percent_of_all
FROM (SELECT 'same_sender_previous' AS field, same_sender_previous AS equal FROM single UNION ALL SELECT 'same_sender_next', same_sender_next FROM single
  UNION ALL SELECT 'previous_sender_equals_next', previous_sender_equals_next FROM single) GROUP BY 1""",
)(lambda s, d: singles.continuity(_singles(s, d)))
query(
    "singleton_no_neighbour",
    ONE
    + """SELECT count(*) FILTER (gap_previous IS NULL) AS no_previous, count(*) FILTER (gap_next IS NULL) AS no_next,
  count(*) FILTER (gap_previous IS NULL AND gap_next IS NULL) AS neither,
  count(*) FILTER (gap_previous IS NULL AND gap_next IS NULL AND topic IS NULL) AS neither_unknown_topic FROM single""",
)(lambda s, d: singles.no_neighbour(_singles(s, d)))
query("singleton_long_replies", ONE + "SELECT count(*) AS n, median(reply_target_gap_seconds) AS median_seconds, max(reply_target_gap_seconds) AS max_seconds FROM single WHERE reply_target_gap_seconds > 3600")(
    lambda s, d: singles.long_reply_stats(_singles(s, d), 3600)
)
query(
    "singleton_overview",
    ONE
    + """SELECT count(*) AS singles, count(topic) AS known_topic, count(*) - count(topic) AS unknown_topic,
  count(*) FILTER (reply_target_type = 'none') AS reply_target_none, count(*) FILTER (reply_target_type = 'missing') AS reply_target_missing,
  count(*) FILTER (reply_target_type = 'service') AS reply_target_service, count(*) FILTER (reply_target_type = 'message') AS reply_target_message,
  count(*) FILTER (coalesce(replies_to_previous, FALSE) OR coalesce(previous_replies, FALSE) OR coalesce(replies_to_next, FALSE) OR coalesce(next_replies, FALSE)) AS direct_relationship_with_neighbour,
  count(*) FILTER (topic IS NOT NULL AND previous_id IS NULL) AS first_of_topic, count(*) FILTER (topic IS NOT NULL AND next_id IS NULL) AS last_of_topic FROM single""",
)(lambda s, d: singles.overview(_singles(s, d)))


@query(
    "long_distance_reply_rows",
    SEG
    + """SELECT p.message_id, epoch_us(p.ts) AS us, p.sender, a.topic, p.reply_to, epoch_us(parent_ts) AS target_us, parent_sender AS target_sender, gap AS gap_seconds,
  gap / 3600 AS gap_hours, gap / 86400 AS gap_days, x.conversation_id, y.conversation_id AS target_conversation_id, x.conversation_id = y.conversation_id AS same_candidate
FROM edge JOIN p ON p.message_id = child JOIN a ON a.message_id = child JOIN member x ON x.message_id = child AND x.threshold = 60
  JOIN member y ON y.message_id = parent AND y.threshold = 60 WHERE gap > 14400""",
)
def _long_rows(s, d):
    msgs, found, _, members = _segments(s, d)
    rows = singles.long_distance(msgs, found, members.where("threshold = 60"), 14400)
    return rows.withColumns(micros(us="ts", target_us="target_ts")).drop("ts", "target_ts")


_NEAR = "coalesce(gap_previous < {0} AND gap_next < {0}, FALSE)"
query(
    "singleton_review_sample",
    ONE
    + ", topical AS (SELECT arg_min(message_id, (md5('%d:' || message_id), message_id)) AS k_, '1' AS b_, 'cover' AS stratum FROM single WHERE topic IS NOT NULL GROUP BY topic),\n" % sampling.SEED
    + picks_sql(
        "single", "message_id",
        {
            "both_sides_under_5m": _NEAR.format(300), "both_sides_5_to_10m": f"{_NEAR.format(600)} AND NOT {_NEAR.format(300)}", "both_sides_10_to_30m": f"{_NEAR.format(1800)} AND NOT {_NEAR.format(600)}",
            "same_sender": "same_sender_previous OR same_sender_next", "different_sender": "NOT same_sender_previous OR NOT same_sender_next", "normal_direct_reply_related": "reply_target_type = 'message' OR incoming > 0",
            "system_reply_reference_only": "reply_target_type = 'service'", "no_reply": "reply_to IS NULL", "large_gap_over_24h": "gap_previous > 86400 OR gap_next > 86400", "unknown_topic": "topic IS NULL",
        },
        12, 150, sampling.SEED, cover="SELECT * FROM topical",
    )
    + "SELECT k_ AS message_id, stratum FROM picks",
)(lambda s, d: singles.review_sample(_singles(s, d)))


# Joining by role


@shared
def _placed(s, d):
    msgs = m_roled(s, d)
    found = graph.persisted(graph.ancestors(msgs))
    decided = segmentation.merged(segmentation.weak_proposals(msgs, found), (60,))
    members = segmentation.membership(msgs, found, decided, (60,))
    return msgs, found, graph.persisted(reconstruct.placed(msgs, members))


@shared
def _rebuilt(s, d):
    minutes = 30
    msgs, found, rows = _placed(s, d)
    offers = graph.persisted(reconstruct.proposals(rows, minutes))
    decisions = graph.persisted(reconstruct.decided(offers, rows))
    again = graph.persisted(reconstruct.rebuilt(rows, decisions, minutes))
    return msgs, found, reconstruct.audit(offers, decisions), again


REB = ds.offers(PLACED, 30)
RISK = ds.risks(REB, "again30", "risk30")
_AUDIT = (
    REB
    + """, verdict AS (SELECT t.topic, t.ca, t.cb, t.row_a, t.row_b, go30.verdict FROM todo30 t JOIN go30 ON go30.topic = t.topic AND go30.k = t.k),
audited AS (SELECT o.*, coalesce(CASE WHEN v.verdict = 'MERGE' THEN 'MERGE' END, 'NO_MERGE') AS decision,
    coalesce(o.reject, CASE WHEN v.verdict <> 'MERGE' THEN v.verdict END) AS rejection
  FROM offer30 o LEFT JOIN verdict v ON v.ca = o.ca AND v.cb = o.cb AND v.row_a = o.ea.row_idx AND v.row_b = o.eb.row_idx AND o.reject IS NULL)
"""
)
query(
    "merge_proposals",
    _AUDIT
    + """SELECT ca AS candidate_a, cb AS candidate_b, ta AS topic, gap AS gap_seconds, ea.role || ',' || eb.role AS roles_at_boundary, ea.id || ',' || eb.id AS boundary_message_ids,
  ea.row_idx AS row_a, eb.row_idx AS row_b, array_to_string(shared, ',') AS shared_participants, array_to_string(shared_others, ',') AS shared_non_agent_participants,
  array_to_string(why, ',') AS merge_reason, score AS merge_score, rejection AS rejection_reason, scope AS evidence_scope, decision FROM audited""",
)(lambda s, d: _rebuilt(s, d)[2].withColumns(joined("roles_at_boundary", "boundary_message_ids", "shared_participants", "shared_non_agent_participants", "merge_reason")).drop("bridge_witnesses", "component_shared"))
query(
    "merge_bridges",
    REB + "SELECT l AS candidate_a, r AS candidate_b, array_to_string(reasons, ',') AS reasons FROM bridge30",
)(lambda s, d: reconstruct.bridges(reconstruct.runs(_placed(s, d)[2]), 30).select(F.col("left").alias("candidate_a"), F.col("right").alias("candidate_b"), F.array_join("reasons", ",").alias("reasons")))
query(
    "merge_reasons",
    _AUDIT
    + """SELECT 'accepted' AS kind, reason, count(*) AS n FROM (SELECT unnest(why) AS reason FROM audited WHERE decision = 'MERGE') GROUP BY 2
UNION ALL SELECT 'rejected', rejection, count(*) FROM audited WHERE decision = 'NO_MERGE' GROUP BY 2""",
)(lambda s, d: reconstruct.reasons(_rebuilt(s, d)[2]))
query("role_aware_membership", REB + "SELECT conversation_id, source_id, message_id, role, topic FROM again30")(lambda s, d: _rebuilt(s, d)[3].select("conversation_id", "source_id", "message_id", "role", "topic"))
query("overmerge_risk", RISK + "SELECT conversation_id, topic, start_us, end_us, message_count, sender_count, source_count, array_to_string(agent_senders, ',') AS agent_senders, array_to_string(non_agent_senders, ',') AS non_agent_senders, first_row, reply_trees, array_to_string(flags, ',') AS flags, risk, len(agent_senders) > 0 AS contains_agent, contains_bot, duration_seconds FROM risk30")(
    lambda s, d: reconstruct.risks(_rebuilt(s, d)[3]).withColumns(joined("agent_senders", "non_agent_senders", "flags") | micros(start_us="start_ts", end_us="end_ts")).drop("start_ts", "end_ts")
)
_FULL = (
    ds.risks(_AUDIT, "again30", "risk30")
    + """, sources AS (SELECT conversation_id, string_agg(source_id, ',' ORDER BY first) AS ids
  FROM (SELECT conversation_id, source_id, min(row_idx) AS first FROM again30 GROUP BY 1, 2) GROUP BY 1),
owner AS (SELECT DISTINCT source_id, conversation_id FROM again30),
merges AS (SELECT conversation_id, list_sort(list_distinct(flatten(list(why)))) AS why, max(score) AS score, count(*) AS n
  FROM audited JOIN owner ON source_id = ca WHERE decision = 'MERGE' GROUP BY 1),
late AS (SELECT DISTINCT conversation_id FROM edge JOIN again30 ON message_id = child WHERE edge.gap > 86400),
whole AS (SELECT risk30.*, sources.ids, coalesce(merges.why, []) AS why, coalesce(merges.score, 0) AS score, coalesce(merges.n, 0) AS edges,
    late.conversation_id IS NOT NULL AS late, source_count = 1 AND len(flags) > 0 AS old_risk
  FROM risk30 JOIN sources USING (conversation_id) LEFT JOIN merges USING (conversation_id) LEFT JOIN late USING (conversation_id))
"""
)


@shared
def _whole(s, d):
    msgs, found, audited, again = _rebuilt(s, d)
    full = reconstruct.conversations(again, reconstruct.risks(again), audited, graph.direct_edges(graph.parents(msgs)))
    return msgs, found, audited, again, full


query("rebuilt_conversations", _FULL + "SELECT conversation_id, ids AS source_candidate_ids, array_to_string(why, ',') AS merge_reason, score AS merge_score, edges AS merge_edges, late AS has_long_distance_reply, old_risk AS risk_predates_reconstruction, message_count, risk FROM whole")(
    lambda s, d: _whole(s, d)[4].select("conversation_id", *[c.alias(n) for n, c in joined("source_candidate_ids", "merge_reason").items()], "merge_score", "merge_edges", "has_long_distance_reply", "risk_predates_reconstruction", "message_count", "risk")
)
_TRACE = (
    _FULL
    + """, lone AS (SELECT source_id, min(message_id) AS message_id, min(conversation_id) AS conversation_id FROM again30 GROUP BY 1 HAVING count(*) = 1),
ends_ AS (SELECT ca AS source_id, why, oc FROM (SELECT *, shared_others AS oc FROM audited WHERE decision = 'MERGE') UNION ALL SELECT cb, why, shared_others FROM audited WHERE decision = 'MERGE'),
reason AS (SELECT source_id, list_sort(list_distinct(flatten(list(why)))) AS why FROM ends_ GROUP BY 1),
beside AS (SELECT message_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap_previous, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS gap_next
  FROM a WHERE topic IS NOT NULL WINDOW w AS (PARTITION BY topic ORDER BY ts, row_idx)),
trace AS (SELECT lone.*, source_count > 1 AS was_merged, message_count AS new_message_count, len(agent_senders) > 0 AS agent_involved,
    array_to_string(coalesce(reason.why, []), ',') AS merge_reason, gap_previous, gap_next
  FROM lone JOIN risk30 USING (conversation_id) LEFT JOIN reason USING (source_id) LEFT JOIN beside USING (message_id))
"""
)


@shared
def _trace(s, d):
    msgs, found, audited, again, full = _whole(s, d)
    near = segmentation.topic_neighbours(msgs, found)
    return full, reconstruct.singleton_trace(again, full, audited, near)


query("singleton_reconstruction", _TRACE + "SELECT message_id, source_id, conversation_id, was_merged, new_message_count, agent_involved, merge_reason, gap_previous, gap_next FROM trace")(
    lambda s, d: _trace(s, d)[1].withColumns(joined("merge_reason")).drop("shared_non_agent_participant")
)
query("singleton_destinations", _TRACE + "SELECT new_message_count, count(*) AS n FROM trace WHERE was_merged GROUP BY 1")(lambda s, d: reconstruct.destinations(_trace(s, d)[1]))


@query("rebuilt_review_sample")
def _review(s, d):
    full, trace = _trace(s, d)
    return reconstruct.review_sample(graph.persisted(full), graph.persisted(trace), 30)


def _metrics_sql(label: str, table: str, rows: str) -> str:
    return f"""SELECT '{label}' AS variant, count(*) AS conversations, count(*) FILTER (message_count = 1) AS singleton_count,
  100.0 * count(*) FILTER (message_count = 1) / count(*) AS singleton_percent, avg(message_count) AS message_count_mean, quantile_cont(message_count, 0.5) AS message_count_median,
  quantile_cont(message_count, 0.9) AS message_count_p90, max(message_count) AS message_count_max, quantile_cont(duration_seconds, 0.5) AS duration_seconds_median,
  quantile_cont(duration_seconds, 0.9) AS duration_seconds_p90, max(duration_seconds) AS duration_seconds_max, 100.0 * count(*) FILTER (sender_count > 1) / count(*) AS multi_sender_percent,
  100.0 * count(*) FILTER (len(agent_senders) > 0) / count(*) AS contains_agent_percent, count(*) FILTER (len(agent_senders) = 0) AS zero_agent_conversations,
  count(*) FILTER (len(agent_senders) = 1) AS one_agent_conversations, count(*) FILTER (len(agent_senders) > 1) AS multiple_agent_conversations,
  count(*) FILTER (message_count > 20) AS over_20_messages, count(*) FILTER (message_count > 50) AS over_50_messages, count(*) FILTER (message_count > 100) AS over_100_messages,
  count(*) FILTER (risk = 'MEDIUM') AS risk_medium_count, count(*) FILTER (risk = 'HIGH') AS risk_high_count,
  count(*) FILTER (risk = 'MEDIUM' AND source_count > 1) AS risk_medium_newly_merged_count, count(*) FILTER (risk = 'HIGH' AND source_count > 1) AS risk_high_newly_merged_count,
  (SELECT count(*) FROM m WHERE service) AS system_event_records, CAST(sum(message_count) AS BIGINT) + (SELECT count(*) FROM m WHERE service) AS preserved_message_count,
  (SELECT count(*) FROM edge JOIN {rows} x ON x.message_id = parent JOIN {rows} y ON y.message_id = child WHERE x.conversation_id <> y.conversation_id) AS direct_reply_broken_count
FROM {table}"""


def _variants_sql() -> str:
    sql = ds.risks(PLACED + ", again0 AS (SELECT r.*, conversation_id AS source_id FROM r)\n", "again0", "risk0")
    for t in reconstruct.WINDOWS:
        sql = ds.risks(ds.offers(sql, t), f"again{t}", f"risk{t}")
    return sql + "\nUNION ALL ".join([_metrics_sql("Baseline", "risk0", "again0"), *[_metrics_sql(f"{t}m", f"risk{t}", f"again{t}") for t in reconstruct.WINDOWS]])


@query("reconstruction_comparison", _variants_sql())
def _variants(s, d):
    msgs, _, rows = _placed(s, d)
    edges, services = graph.persisted(graph.direct_edges(graph.parents(msgs))), msgs.where("message_type = 'service'").count()
    base = rows.withColumn("source_id", F.col("conversation_id"))
    out = reconstruct.metrics(reconstruct.risks(base), "Baseline", edges, base, services)
    for minutes in reconstruct.WINDOWS:
        decisions = graph.persisted(reconstruct.decided(reconstruct.proposals(rows, minutes), rows))
        again = graph.persisted(reconstruct.rebuilt(rows, decisions, minutes))
        out = out.unionByName(reconstruct.metrics(reconstruct.risks(again), f"{minutes}m", edges, again, services))
    return out


from colloquy.plans import agents  # noqa: E402, F401  (registers the queries about agent messages)
