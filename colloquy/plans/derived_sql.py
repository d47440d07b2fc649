"""SQL of the order-dependent stages: merging by gap, joining by role, episodes, as recursive queries.

Each text is a prelude of common table expressions. The greedy merges go through their proposals one by one,
all topics side by side; the state of a topic is a list with a row for each set member.
"""

from __future__ import annotations

THRESHOLDS = "thr(t) AS (VALUES (10), (30), (60), (120))"


def segments(ancestors: str) -> str:
    """ancestors and member (threshold, conversation_id, message_id, row_idx, topic, component, sender, ts), prop, walk, cut, edge."""
    return (
        ancestors
        + f""",
{THRESHOLDS},
near AS (SELECT a.message_id, a.sender, a.ts, a.row_idx, a.topic, comp.component_row AS c, comp.component_size AS size,
    lag(a.message_id) OVER w AS pm, lag(a.sender) OVER w AS ps, lag(a.ts) OVER w AS pt, lag(a.row_idx) OVER w AS pr,
    lag(comp.component_row) OVER w AS pc, lag(comp.component_size) OVER w AS psize
  FROM a JOIN comp USING (head) WHERE a.topic IS NOT NULL WINDOW w AS (PARTITION BY a.topic ORDER BY a.row_idx)),
prop AS (SELECT topic, (epoch_us(ts) - epoch_us(pt)) / 1e6 AS gap, pm AS x, message_id AS y, pc AS cx, c AS cy, psize AS nx, size AS ny,
    row_number() OVER (PARTITION BY topic ORDER BY epoch_us(ts) - epoch_us(pt), row_idx, pr) AS k
  FROM near WHERE ps = sender AND pc <> c),
ends AS (SELECT topic, cx AS c, nx AS n FROM prop UNION SELECT topic, cy, ny FROM prop),
walk AS (
  SELECT topic, CAST(0 AS BIGINT) AS k, list({{'c': c, 'r': c, 'n': n}}) AS lab, CAST(NULL AS VARCHAR) AS kind FROM ends GROUP BY topic
  UNION ALL
  SELECT topic, k, CASE WHEN kind = 'accepted'
      THEN list_transform(lab, lambda z: {{'c': z.c, 'r': CASE WHEN z.r = rb THEN ra ELSE z.r END, 'n': z.n}}) ELSE lab END, kind
  FROM (SELECT *, CASE WHEN ra = rb THEN 'same'
      WHEN len(list_filter(lab, lambda z: z.r = ra AND z.n > 1)) > 0 AND len(list_filter(lab, lambda z: z.r = rb AND z.n > 1)) > 0
      THEN 'blocked' ELSE 'accepted' END AS kind
    FROM (SELECT walk.topic, p.k, walk.lab, list_filter(walk.lab, lambda z: z.c = p.cx)[1].r AS ra,
        list_filter(walk.lab, lambda z: z.c = p.cy)[1].r AS rb
      FROM walk JOIN prop p ON p.topic = walk.topic AND p.k = walk.k + 1))),
cut AS (SELECT prop.topic, thr.t, count(*) FILTER (prop.gap <= thr.t * 60) AS k FROM prop, thr GROUP BY 1, 2),
lab AS (SELECT t, unnest(lab, recursive := true) FROM cut JOIN walk USING (topic, k)),
named AS (SELECT thr.t, a.message_id, a.row_idx, a.topic, a.sender, a.ts, comp.component_row AS c,
    coalesce(lab.r, comp.component_row) AS root
  FROM a JOIN comp USING (head) CROSS JOIN thr LEFT JOIN lab ON lab.t = thr.t AND lab.c = comp.component_row),
member AS (SELECT t AS threshold, 'candidate_' || t || 'm_' || (min(row_idx) OVER (PARTITION BY t, root)) AS conversation_id,
    message_id, row_idx, topic, CAST(c AS VARCHAR) AS component, sender, ts FROM named),
edge AS (SELECT parent_id AS parent, message_id AS child, (epoch_us(ts) - epoch_us(parent_ts)) / 1e6 AS gap
  FROM p WHERE parent_id IS NOT NULL AND NOT parent_service),
stepped AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY threshold, conversation_id ORDER BY row_idx))) / 1e6 AS gap FROM member),
talk0 AS (SELECT threshold, conversation_id, max(topic) AS topic, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us,
    count(*) AS message_count, count(DISTINCT sender) AS sender_count, coalesce(max(gap), 0) AS max_internal_gap_seconds,
    string_agg(DISTINCT component, ',' ORDER BY component) AS components, min(row_idx) AS first_row
  FROM stepped GROUP BY 1, 2),
inner_replies AS (SELECT threshold, conversation_id, count(*) AS direct_reply_count, count(*) FILTER (gap > threshold * 60) AS long_replies
  FROM (SELECT member.threshold, member.conversation_id, edge.gap FROM edge JOIN member ON edge.child = member.message_id) GROUP BY 1, 2),
talk AS (SELECT talk0.*, (end_us - start_us) / 1e6 AS duration_seconds, coalesce(direct_reply_count, 0) AS direct_reply_count,
    coalesce(long_replies, 0) AS long_replies
  FROM talk0 LEFT JOIN inner_replies USING (threshold, conversation_id))
"""
    )


def singles(ancestors: str) -> str:
    """segments and single: the conversations of one message at 60 minutes, with neighbours, relations and class."""
    relations = "".join(
        f""",
    CASE WHEN {s}_id IS NOT NULL THEN coalesce(l.parent_id = {s}_id, FALSE) END AS replies_to_{s},
    CASE WHEN {s}_id IS NOT NULL THEN coalesce({t}.parent_id = l.message_id, FALSE) END AS {s}_replies,
    CASE WHEN {s}_id IS NOT NULL THEN coalesce(l.parent_id = {t}.parent_id, FALSE) END AS same_target_{s},
    CASE WHEN {s}_id IS NOT NULL THEN l.sender = {s}_sender END AS same_sender_{s},
    CASE WHEN {s}_id IS NOT NULL THEN coalesce(l.parent_id = {t}.parent_id, FALSE) AND coalesce(l.parent_service, FALSE) END AS same_system_target_{s}"""
        for s, t in (("previous", "lp"), ("next", "ln"))
    )
    close = {s: f"(coalesce(gap_{s} <= 3600, FALSE) OR coalesce(replies_to_{s} OR {s}_replies, FALSE))" for s in ("previous", "next")}
    return (
        segments(ancestors)
        + f""",
beside AS (SELECT message_id, lag(message_id) OVER w AS previous_id, lag(sender) OVER w AS previous_sender,
    (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap_previous, lead(message_id) OVER w AS next_id,
    lead(sender) OVER w AS next_sender, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS gap_next
  FROM a WHERE topic IS NOT NULL WINDOW w AS (PARTITION BY topic ORDER BY ts, row_idx)),
inbound AS (SELECT parent_id AS message_id, count(*) AS incoming FROM p WHERE parent_id IS NOT NULL AND NOT parent_service GROUP BY 1),
alone AS (SELECT conversation_id, min(message_id) AS message_id, min(topic) AS topic FROM member WHERE threshold = 60 GROUP BY 1 HAVING count(*) = 1),
related AS (SELECT alone.conversation_id, alone.topic, l.message_id, l.sender, l.reply_to, l.parent_id, l.parent_service,
    beside.* EXCLUDE (message_id), coalesce(inbound.incoming, 0) AS incoming, previous_sender = next_sender AS previous_sender_equals_next,
    CASE WHEN NOT l.parent_service THEN (epoch_us(l.ts) - epoch_us(l.parent_ts)) / 1e6 END AS reply_target_gap_seconds{relations}
  FROM alone JOIN p l USING (message_id) LEFT JOIN beside ON beside.message_id = l.message_id LEFT JOIN inbound ON inbound.message_id = l.message_id
    LEFT JOIN p lp ON lp.message_id = previous_id LEFT JOIN p ln ON ln.message_id = next_id),
single AS (SELECT *, CASE WHEN reply_target_gap_seconds > 86400 THEN 'LONG_DISTANCE_REPLY'
    WHEN topic IS NULL OR (reply_to IS NOT NULL AND parent_id IS NULL) THEN 'UNKNOWN'
    WHEN {close['previous']} AND {close['next']} THEN 'POSSIBLE_BOTH' WHEN {close['previous']} THEN 'POSSIBLE_PREVIOUS'
    WHEN {close['next']} THEN 'POSSIBLE_NEXT' ELSE 'STRUCTURALLY_ISOLATED' END AS structural_classification,
    CASE WHEN reply_to IS NULL THEN 'none' WHEN parent_id IS NULL THEN 'missing' WHEN parent_service THEN 'service' ELSE 'message' END AS reply_target_type
  FROM related)
"""
    )


def placed(ancestors: str, role: str) -> str:
    """segments and r: the messages of the 60-minute conversations with role, which the expression gives for a sender."""
    return (
        segments(ancestors)
        + f""",
r AS (SELECT message_id, sender, ts, {role} AS role, row_idx, conversation_id, topic, component,
    count(*) OVER (PARTITION BY component) AS in_tree FROM member WHERE threshold = 60),
who AS (SELECT conversation_id AS cid, coalesce(list_sort(list(DISTINCT sender) FILTER (role <> 'BOT')), []) AS humans,
    coalesce(list_sort(list(DISTINCT sender) FILTER (role = 'AGENT')), []) AS agents,
    coalesce(list_sort(list(DISTINCT sender) FILTER (role NOT IN ('AGENT', 'BOT'))), []) AS others, bool_or(in_tree > 1) AS tree
  FROM r GROUP BY 1),
fresh AS (SELECT *, CASE WHEN lag(conversation_id) OVER (PARTITION BY topic ORDER BY ts, row_idx) = conversation_id THEN 0 ELSE 1 END AS f
  FROM r WHERE topic IS NOT NULL),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY topic ORDER BY ts, row_idx) AS run FROM fresh),
stretch AS (SELECT topic, run, any_value(conversation_id) AS cid, arg_min(pt, (ts, row_idx)) AS a, arg_max(pt, (ts, row_idx)) AS z
  FROM (SELECT *, {{'ts': ts, 'row_idx': row_idx, 'id': message_id, 'sender': sender, 'role': role}} AS pt FROM numbered) GROUP BY 1, 2)
"""
    )


def offers(prelude: str, minutes: int) -> str:
    """prelude (of `placed`) and tables whose names end in minutes: bridge, offer, go, join_ (decisions), top (member, root), again."""
    m = minutes
    plain = "{0}.role NOT IN ('AGENT', 'BOT')"
    gap = "(epoch_us({0}.ts) - epoch_us({1}.ts)) / 1e6"
    return (
        prelude
        + f""",
three{m} AS (SELECT *, {gap.format('ma', 'x')} AS g1, {gap.format('v', 'mz')} AS g2 FROM (SELECT topic, cid, z AS x, lead(cid) OVER w AS mc,
    lead(a) OVER w AS ma, lead(z) OVER w AS mz, lead(cid, 2) OVER w AS fc, lead(a, 2) OVER w AS v FROM stretch WINDOW w AS (PARTITION BY topic ORDER BY run))
  WHERE fc IS NOT NULL),
hit{m} AS (SELECT *, CASE WHEN back THEN ['agent_bridge', 'other_agent_same_other', 'shared_non_agent_participant'] ELSE ['agent_other_agent'] END AS reasons
  FROM (SELECT *, {plain.format('x')} AND ma.role = 'AGENT' AND mz.role = 'AGENT' AND x.sender = v.sender AS back,
      x.role = 'AGENT' AND v.role = 'AGENT' AND {plain.format('ma')} AND ma.sender = mz.sender AS across FROM three{m}
    WHERE greatest(g1, g2) <= {m * 60} AND x.role <> 'BOT' AND ma.role <> 'BOT' AND mz.role <> 'BOT' AND v.role <> 'BOT')
  WHERE back OR across),
bridge{m} AS (SELECT least(p_, q_) AS l, greatest(p_, q_) AS r, list_sort(list_distinct(flatten(list(reasons)))) AS reasons
  FROM (SELECT cid AS p_, mc AS q_, reasons FROM hit{m} UNION ALL SELECT mc, fc, reasons FROM hit{m}) GROUP BY 1, 2),
pair{m} AS (
  SELECT cid AS ca, nc AS cb, z AS ea, na AS eb, topic AS ta, topic AS tb, 'same_topic_boundary' AS scope
  FROM (SELECT *, lead(cid) OVER w AS nc, lead(a) OVER w AS na FROM stretch WINDOW w AS (PARTITION BY topic ORDER BY run)) WHERE nc IS NOT NULL
  UNION ALL
  SELECT lc, conversation_id, le, pt, lt, topic, 'global_guardrail_only'
  FROM (SELECT *, lag(conversation_id) OVER w AS lc, lag(topic) OVER w AS lt, lag(pt) OVER w AS le
    FROM (SELECT *, {{'ts': ts, 'row_idx': row_idx, 'id': message_id, 'sender': sender, 'role': role}} AS pt FROM r) WINDOW w AS (ORDER BY row_idx))
  WHERE lc <> conversation_id AND (topic IS NULL OR lt IS NULL OR topic <> lt)),
seen{m} AS (SELECT pair{m}.*, {gap.format('eb', 'ea')} AS gap, bridge{m}.reasons,
    list_sort(list_intersect(wa.humans, wb.humans)) AS shared, list_sort(list_intersect(wa.others, wb.others)) AS shared_others,
    (ea.role = 'AGENT' AND {plain.format('eb')}) OR (eb.role = 'AGENT' AND {plain.format('ea')}) AS answer
  FROM pair{m} JOIN who wa ON wa.cid = ca JOIN who wb ON wb.cid = cb LEFT JOIN bridge{m} ON l = least(ca, cb) AND bridge{m}.r = greatest(ca, cb)),
judged{m} AS (SELECT *, CASE WHEN ta IS DISTINCT FROM tb THEN 'different_topic' WHEN ta IS NULL THEN 'unknown_topic_no_direct_reply'
    WHEN ea.role = 'BOT' OR eb.role = 'BOT' THEN 'bot_boundary_no_evidence' WHEN gap > {m * 60} THEN 'outside_merge_window'
    WHEN reasons IS NULL AND NOT answer AND len(shared) = 0 THEN 'unknown_only_or_no_role_participant_evidence' END AS reject FROM seen{m}),
offer{m} AS (SELECT *, CASE WHEN reject IS NOT NULL THEN [] WHEN reasons IS NOT NULL THEN reasons
    WHEN answer THEN ['agent_response_pair', CASE WHEN ea.role = 'AGENT' THEN 'agent_to_other' ELSE 'other_to_agent' END]
    WHEN len(shared_others) > 0 THEN ['participant_continuity', 'shared_non_agent_participant'] ELSE ['participant_continuity'] END AS why,
    CASE WHEN reject IS NOT NULL THEN 0 WHEN reasons IS NOT NULL THEN 90 WHEN answer THEN 80 ELSE 50 END AS score FROM judged{m}),
todo{m} AS (SELECT ta AS topic, ca, cb, score, eb.row_idx AS row_b, ea.row_idx AS row_a,
    row_number() OVER (PARTITION BY ta ORDER BY score DESC, gap, eb.row_idx, ea.row_idx) AS k FROM offer{m} WHERE reject IS NULL),
go{m} AS (
  SELECT topic, CAST(0 AS BIGINT) AS k, list({{'c': cid, 'r': cid, 'o': others, 'g': agents, 't': tree}}) AS st, CAST(NULL AS VARCHAR) AS verdict
  FROM (SELECT DISTINCT topic, unnest([ca, cb]) AS cid FROM todo{m}) JOIN who USING (cid) GROUP BY topic
  UNION ALL
  SELECT topic, k, CASE WHEN verdict = 'MERGE'
      THEN list_transform(st, lambda z: {{'c': z.c, 'r': CASE WHEN z.r = rb THEN ra ELSE z.r END, 'o': z.o, 'g': z.g, 't': z.t}}) ELSE st END, verdict
  FROM (SELECT *, CASE WHEN ra = rb THEN 'already_connected'
      WHEN len(oa) > 0 AND len(ob) > 0 AND NOT list_has_any(oa, ob) THEN 'different_non_agent_participants_component_guard'
      WHEN ta AND tb AND NOT (list_has_any(oa, ob) AND len(ga) > 0 AND score >= 80) THEN 'independent_reply_structures_without_strong_shared_context'
      ELSE 'MERGE' END AS verdict
    FROM (SELECT *, flatten(list_transform(list_filter(st, lambda z: z.r = ra), lambda z: z.o)) AS oa,
        flatten(list_transform(list_filter(st, lambda z: z.r = rb), lambda z: z.o)) AS ob,
        flatten(list_transform(list_filter(st, lambda z: z.r = ra OR z.r = rb), lambda z: z.g)) AS ga,
        len(list_filter(st, lambda z: z.r = ra AND z.t)) > 0 AS ta, len(list_filter(st, lambda z: z.r = rb AND z.t)) > 0 AS tb
      FROM (SELECT go{m}.topic, e.k, go{m}.st, e.score, list_filter(go{m}.st, lambda z: z.c = e.ca)[1].r AS ra,
          list_filter(go{m}.st, lambda z: z.c = e.cb)[1].r AS rb
        FROM go{m} JOIN todo{m} e ON e.topic = go{m}.topic AND e.k = go{m}.k + 1)))),
top{m} AS (SELECT c AS cid, r AS root FROM (SELECT unnest(st, recursive := true)
  FROM go{m} JOIN (SELECT topic, max(k) AS k FROM todo{m} GROUP BY 1) USING (topic, k))),
again{m} AS (SELECT r.* EXCLUDE (conversation_id), r.conversation_id AS source_id,
    'agent_{m}m_' || arg_min(message_id, row_idx) OVER (PARTITION BY coalesce(root, conversation_id)) AS conversation_id
  FROM r LEFT JOIN top{m} ON cid = conversation_id)
"""
    )


def risks(prelude: str, rows: str, name: str) -> str:
    """prelude and the table name: a row for each conversation of rows, with flags and risk."""
    return (
        prelude
        + f""",
{name}_step AS (SELECT *, lag({{'sender': sender, 'role': role, 'ts': ts}}) OVER (PARTITION BY conversation_id ORDER BY row_idx) AS b FROM {rows}),
{name}_met AS (SELECT conversation_id, row_idx, epoch_us(ts) AS us, CASE WHEN role = 'AGENT' THEN sender ELSE b.sender END AS agent,
    CASE WHEN role = 'AGENT' THEN b.sender ELSE sender END AS person
  FROM {name}_step WHERE epoch_us(ts) - epoch_us(b.ts) <= 600000000
    AND ((b.role = 'AGENT' AND role NOT IN ('AGENT', 'BOT')) OR (role = 'AGENT' AND b.role NOT IN ('AGENT', 'BOT')))),
{name}_busy AS (SELECT DISTINCT x.conversation_id FROM {name}_met x JOIN {name}_met y
  ON x.conversation_id = y.conversation_id AND x.agent = y.agent AND y.us BETWEEN x.us AND x.us + 600000000 AND y.person <> x.person),
{name} AS (SELECT *, CASE WHEN len(flags) >= 2 OR list_contains(flags, 'D_over_20_messages') THEN 'HIGH' WHEN len(flags) = 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk
  FROM (SELECT *, list_filter([CASE WHEN len(non_agent_senders) >= 3 THEN 'A_three_or_more_non_agents' END,
      CASE WHEN busy THEN 'B_same_agent_multiple_non_agents_within_10m' END, CASE WHEN source_count >= 4 THEN 'C_four_or_more_source_candidates' END,
      CASE WHEN message_count > 20 THEN 'D_over_20_messages' END,
      CASE WHEN reply_trees >= 2 THEN 'E_multiple_independent_reply_components' END], lambda f: f IS NOT NULL) AS flags
    FROM (SELECT conversation_id, max(topic) AS topic, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS message_count,
        count(DISTINCT sender) AS sender_count, count(DISTINCT source_id) AS source_count,
        coalesce(list_sort(list(DISTINCT sender) FILTER (role = 'AGENT')), []) AS agent_senders,
        coalesce(list_sort(list(DISTINCT sender) FILTER (role NOT IN ('AGENT', 'BOT'))), []) AS non_agent_senders,
        bool_or(role = 'BOT') AS contains_bot, min(row_idx) AS first_row,
        count(DISTINCT CASE WHEN in_tree > 1 THEN component END) AS reply_trees, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds,
        conversation_id IN (SELECT conversation_id FROM {name}_busy) AS busy
      FROM {rows} GROUP BY conversation_id)))
"""
    )
