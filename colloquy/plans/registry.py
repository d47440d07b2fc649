"""Queries by name over the driver's tables, and the SQL that each equals where SQL can say it.

M is the events table read as a chat, C the conversations table with roles, D documents, P pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import checks, graph, profile, roles, sampling, segmentation
from colloquy.plans.base import A, M, QUERIES, SQL, X, XK, documents, faulted, m, query, roled, texted
from colloquy.plans.stages import picks_sql
from colloquy.sources import pages as html

_GAPS = M + ", g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY row_idx))) / 1e6 AS gap FROM n) "
query("gap_histogram", _GAPS + """, c AS (SELECT CASE WHEN gap < 60 THEN '<1 minute' WHEN gap < 300 THEN '1-5 minutes' WHEN gap < 600 THEN '5-10 minutes' WHEN gap < 1800 THEN '10-30 minutes' WHEN gap < 3600 THEN '30-60 minutes' WHEN gap <= 21600 THEN '1-6 hours' ELSE '>6 hours' END AS bin, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT b.bin, coalesce(c.n, 0) AS n FROM (VALUES ('<1 minute'), ('1-5 minutes'), ('5-10 minutes'), ('10-30 minutes'), ('30-60 minutes'), ('1-6 hours'), ('>6 hours')) b(bin) LEFT JOIN c ON b.bin = c.bin""")(lambda s, d: profile.gap_histogram(m(s, d)))
query("gap_describe", _GAPS + "SELECT count(gap) AS count, avg(gap) AS mean, quantile_cont(gap, 0.5) AS median, quantile_cont(gap, 0.9) AS p90, quantile_cont(gap, 0.95) AS p95, min(gap) AS min, max(gap) AS max, count(*) FILTER (gap = 0) AS zero_gaps, count(*) FILTER (gap < 0) AS negative_gaps FROM g")(
    lambda s, d: profile.gap_describe(m(s, d))
)
query("daily_counts_zero_filled", M + ", c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM n GROUP BY 1) SELECT CAST(r.day AS DATE) AS day, coalesce(c.n, 0) AS n FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM c) r LEFT JOIN c ON CAST(r.day AS DATE) = c.day")(lambda s, d: profile.daily_counts(m(s, d)))
query("hourly_counts", M + ", c AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM n GROUP BY 1) SELECT CAST(r.h AS INTEGER) AS hour, coalesce(c.n, 0) AS n FROM range(24) r(h) LEFT JOIN c ON r.h = c.hour")(lambda s, d: profile.hourly_counts(m(s, d)))
query("service_counts_by_date", M + "SELECT date_context, count(*) AS n FROM m WHERE service GROUP BY 1")(lambda s, d: profile.service_counts(m(s, d)))
_RUNS = M + ", o AS (SELECT row_idx, sender, CASE WHEN lag(sender) OVER (ORDER BY row_idx) = sender THEN 0 ELSE 1 END AS f FROM n), r AS (SELECT run, sender, count(*) AS length FROM (SELECT *, sum(f) OVER (ORDER BY row_idx) AS run FROM o) GROUP BY 1, 2) "
query("same_sender_runs", _RUNS + "SELECT CAST(run AS BIGINT) AS run, sender, length FROM r")(lambda s, d: profile.same_sender_runs(m(s, d)))
query("run_length_distribution", _RUNS + "SELECT length, count(*) AS runs FROM r GROUP BY 1")(lambda s, d: profile.run_length_distribution(m(s, d)))
query("runs_by_sender", _RUNS + "SELECT sender, count(*) AS runs, max(length) AS max_run_length FROM r GROUP BY 1")(lambda s, d: profile.runs_by_sender(m(s, d)))
query("sender_switches", M + ", o AS (SELECT sender, lag(sender) OVER (ORDER BY row_idx) AS b FROM n) SELECT count(b) AS pairs, count(*) FILTER (b <> sender) AS switches FROM o")(lambda s, d: profile.sender_switches(m(s, d)))
query("global_switch_matrix", M + ", o AS (SELECT sender, lag(sender) OVER (ORDER BY row_idx) AS b FROM n) SELECT b AS from_sender, sender AS to_sender, count(*) AS n FROM o WHERE b <> sender GROUP BY 1, 2")(lambda s, d: profile.global_switch_matrix(m(s, d)))
query("missing_reply_targets", M + "SELECT 'events' AS source_file, message_id, 'events' AS target_source_file, reply_to AS target_id, 'reply' AS scope FROM p WHERE reply_to IS NOT NULL AND parent_id IS NULL")(lambda s, d: checks.missing_reply_targets(m(s, d)))
query("reply_target_types", M + "SELECT CASE WHEN parent_id IS NULL THEN 'missing' WHEN parent_service THEN 'topic_creation_service' ELSE 'message' END AS kind, count(*) AS n FROM p WHERE reply_to IS NOT NULL GROUP BY 1")(lambda s, d: profile.reply_target_types(m(s, d)))
query("top_reply_targets", M + "SELECT 'events' AS target_file, reply_to AS target_id, count(*) AS n, min(row_idx) AS first_row FROM n WHERE reply_to IS NOT NULL GROUP BY 2 ORDER BY n DESC, first_row LIMIT 20")(lambda s, d: profile.top_reply_targets(m(s, d)))
query("reply_chain_depth", A + "SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM a GROUP BY 1")(lambda s, d: graph.ancestors(m(s, d)).groupBy("depth").agg(F.count("*").alias("n")))
query("reply_chain_depth_of_repliers", A + "SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM a JOIN n USING (message_id) WHERE n.reply_to IS NOT NULL GROUP BY 1")(
    lambda s, d: graph.ancestors(m(s, d)).join(m(s, d).where("reply_to is not null").select("message_id"), "message_id").groupBy("depth").agg(F.count("*").alias("n"))
)
query("chain_termination", A + "SELECT CASE WHEN rooted THEN 'service' WHEN lost THEN 'missing_target' ELSE 'normal_no_reply' END AS termination, count(*) AS n FROM a GROUP BY 1")(lambda s, d: graph.ancestors(m(s, d)).groupBy("termination").agg(F.count("*").alias("n")))
query("reply_root_groups", A + "SELECT a.root_id, CASE WHEN m.message_id IS NULL THEN 'missing' WHEN m.service THEN 'service' ELSE 'message' END AS root_type, coalesce(m.service, FALSE) AS is_topic_creation, count(*) AS normal_message_count, count(DISTINCT a.sender) AS distinct_senders, (epoch_us(max(a.ts)) - epoch_us(min(a.ts))) / 1e6 AS span_seconds, CAST(max(depth) AS BIGINT) AS max_depth FROM a LEFT JOIN m ON a.root_id = m.message_id GROUP BY 1, 2, 3")(
    lambda s, d: profile.reply_root_groups(m(s, d), graph.ancestors(m(s, d)))
)
query("topic_contexts", A + "SELECT CASE WHEN rooted THEN 'topic' WHEN lost THEN 'missing_root' ELSE 'unknown_root' END AS context, topic, count(*) AS n FROM a GROUP BY 1, 2")(lambda s, d: graph.ancestors(m(s, d)).groupBy("context", "topic").agg(F.count("*").alias("n")))
query("reply_components", A + "SELECT a.message_id, CAST(comp.component_row AS VARCHAR) AS component, comp.component_size FROM a JOIN comp USING (head)")(lambda s, d: graph.ancestors(m(s, d)).select("message_id", "component", "component_size"))
query("direct_reply_edges", M + "SELECT parent_id AS parent, message_id AS child, (epoch_us(ts) - epoch_us(parent_ts)) / 1e6 AS gap_seconds FROM p WHERE parent_id IS NOT NULL AND NOT parent_service")(lambda s, d: graph.direct_edges(graph.parents(m(s, d))))
query("children_by_parent", M + "SELECT parent_id AS parent, count(*) AS n FROM p WHERE parent_id IS NOT NULL AND NOT parent_service GROUP BY 1")(lambda s, d: graph.direct_edges(graph.parents(m(s, d))).groupBy("parent").agg(F.count("*").alias("n")))
query("near_pair_root_switches", A + ", o AS (SELECT ts, root_id, lag(ts) OVER w AS t1, lag(root_id) OVER w AS r1 FROM a WINDOW w AS (ORDER BY row_idx)) SELECT count(*) AS near_pairs, count(*) FILTER (root_id <> r1) AS root_switches FROM o WHERE epoch_us(ts) - epoch_us(t1) < 300000000")(lambda s, d: profile.near_root_switches(m(s, d), graph.ancestors(m(s, d))))
query("reply_matrix", M + "SELECT sender AS from_sender, parent_sender AS to_sender, count(*) AS n FROM p WHERE parent_id IS NOT NULL AND NOT parent_service GROUP BY 1, 2")(lambda s, d: roles.reply_matrix(m(s, d)))
_ADJ = A + ", o AS (SELECT sender, ts, lag(sender) OVER w AS b, lag(ts) OVER w AS t FROM a WHERE topic IS NOT NULL WINDOW w AS (PARTITION BY topic ORDER BY ts, row_idx)), adj AS (SELECT b AS from_sender, sender AS to_sender, count(*) AS n FROM o WHERE epoch_us(ts) - epoch_us(t) <= 600000000 GROUP BY 1, 2) "
query("adjacency_matrix", _ADJ + "SELECT * FROM adj")(lambda s, d: roles.adjacency_matrix(m(s, d), graph.ancestors(m(s, d))))
query("ranked_partners", M + ", r AS (SELECT sender, parent_sender AS other, count(*) AS c FROM p WHERE parent_id IS NOT NULL AND NOT parent_service AND sender <> parent_sender GROUP BY 1, 2) SELECT sender, other, c AS n, row_number() OVER (PARTITION BY sender ORDER BY c DESC, other) AS rank FROM r")(
    lambda s, d: roles.partners(roles.reply_matrix(m(s, d))).select("sender", F.posexplode("partners").alias("i", "p")).select("sender", F.col("p.sender").alias("other"), F.col("p.count").alias("n"), (F.col("i") + 1).cast("long").alias("rank"))
)
query("weak_merge_proposals", A + ", o AS (SELECT a.*, comp.component_row AS c, lag(message_id) OVER w AS pm, lag(sender) OVER w AS ps, lag(ts) OVER w AS pt, lag(comp.component_row) OVER w AS pc FROM a JOIN comp USING (head) WHERE topic IS NOT NULL WINDOW w AS (PARTITION BY topic ORDER BY row_idx)) SELECT topic, pm AS a, message_id AS b, (epoch_us(ts) - epoch_us(pt)) / 1e6 AS gap FROM o WHERE ps = sender AND pc <> c")(
    lambda s, d: segmentation.weak_proposals(m(s, d), graph.ancestors(m(s, d))).select("topic", "a", "b", "gap")
)
query("long_distance_replies", M + "SELECT parent_id AS parent, message_id AS child, (epoch_us(ts) - epoch_us(parent_ts)) / 1e6 AS gap_seconds FROM p WHERE parent_id IS NOT NULL AND NOT parent_service AND epoch_us(ts) - epoch_us(parent_ts) > 21600000000")(lambda s, d: segmentation.long_distance_replies(graph.direct_edges(graph.parents(m(s, d))), 21600))
query("topic_neighbours", A + ", o AS (SELECT message_id, topic, lag(message_id) OVER w AS previous_id, lead(message_id) OVER w AS next_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap_previous, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS gap_next FROM a WHERE topic IS NOT NULL WINDOW w AS (PARTITION BY topic ORDER BY ts, row_idx)) SELECT * FROM o")(
    lambda s, d: segmentation.topic_neighbours(m(s, d), graph.ancestors(m(s, d))).select("message_id", "topic", "previous_id", "next_id", "gap_previous", "gap_next")
)


query("triangles", M + ", u AS (SELECT DISTINCT least(sender, parent_sender) AS x, greatest(sender, parent_sender) AS y FROM p WHERE parent_id IS NOT NULL AND NOT parent_service AND sender <> parent_sender) SELECT count(*) AS triangles FROM u e JOIN u f ON e.y = f.x JOIN u g ON g.x = e.x AND g.y = f.y")(
    lambda s, d: graph.sender_graph(roles.reply_matrix(m(s, d))).select("triangles")
)
query("sender_interarrival", M + ", g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY row_idx))) / 1e6 AS gap FROM n WHERE sender = 'u1') SELECT count(gap) AS count, round(avg(gap), 6) AS mean, median(gap) AS median, min(gap) AS min, max(gap) AS max, round(stddev_pop(gap) / avg(gap), 6) AS coefficient_of_variation, count(*) FILTER (gap <= 60) AS within_60_seconds FROM g")(
    lambda s, d: roles.interarrival(m(s, d), "u1").withColumns({c: F.round(c, 6) for c in ("mean", "coefficient_of_variation")})
)
query("sender_top_times", M + "SELECT strftime(ts, '%H:%M:%S') AS value, count(*) AS n, min(row_idx) AS first_row FROM n WHERE sender = 'u1' GROUP BY 1 ORDER BY n DESC, first_row LIMIT 5")(lambda s, d: roles.top_values(m(s, d), "u1", "time", 5))
query("role_template", M + "SELECT DISTINCT sender, '' AS role, '' AS confidence, '' AS notes FROM n")(lambda s, d: roles.mapping_template(m(s, d)))

query("exact_duplicate_texts", "WITH c AS (SELECT text, count(*) AS k FROM documents WHERE trim(text, ' \t\n\r') <> '' GROUP BY 1) SELECT count(*) AS distinct_texts, count(*) FILTER (k > 1) AS repeated_text_groups, CAST(coalesce(sum(k) FILTER (k > 1), 0) AS BIGINT) AS members, CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS redundant FROM c")(lambda s, d: profile.duplicate_texts(documents(s, d)))
query("top_texts", "SELECT row_number() OVER (ORDER BY n DESC, first_row) AS rank, n, first_row FROM (SELECT text, count(*) AS n, min(doc_id) AS first_row FROM documents GROUP BY 1 ORDER BY n DESC, first_row LIMIT 50)")(lambda s, d: profile.top_texts(documents(s, d), "doc_id").select(F.col("rank").cast("long").alias("rank"), "n", "first_row"))
query("text_length_stats", "SELECT count(text) AS count, avg(length(text)) AS mean, quantile_cont(length(text), 0.5) AS median, quantile_cont(length(text), 0.9) AS p90, quantile_cont(length(text), 0.95) AS p95, CAST(min(length(text)) AS DOUBLE) AS min, CAST(max(length(text)) AS DOUBLE) AS max, count(*) FILTER (trim(coalesce(text, '')) = '') AS blank FROM documents")(lambda s, d: profile.text_length_stats(documents(s, d)))
query("pii_ip_and_email", r"SELECT count(*) FILTER (regexp_matches(text, '(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}($|[^0-9.])')) AS ip_candidate, count(*) FILTER (regexp_matches(text, '(?i)[\p{L}\p{N}_.+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+')) AS email, count(*) FILTER (regexp_matches(text, '(?i)(https?://|www\.)[^\s<>]')) AS url FROM documents")(
    lambda s, d: profile.pii_counts(documents(s, d)).select("ip_candidate", "email", "url")
)
_C = """WITH c AS (SELECT CAST(conv_id AS BIGINT) * 1000 + turn + 1 AS row_idx, conv_id, turn, role AS r, role || '_' || CAST(conv_id % 3 AS VARCHAR) AS sender, 1700000000 + conv_id * 7200 + turn * 60 AS t FROM conversations),
n AS (SELECT *, CASE WHEN r = 'assistant' THEN 'AGENT' ELSE 'USER' END AS role FROM c WHERE r <> 'system'),
h AS (SELECT n.*, EXISTS (SELECT 1 FROM n q WHERE q.row_idx = n.row_idx - 1) AS up FROM n) """
query("role_attach", _C + "SELECT CAST(row_idx AS VARCHAR) AS message_id, role FROM n UNION ALL SELECT CAST(row_idx AS VARCHAR), 'SYSTEM_EVENT' FROM c WHERE r = 'system' UNION ALL SELECT DISTINCT CAST(conv_id * 1000 AS VARCHAR), 'SYSTEM_EVENT' FROM c")(lambda s, d: roled(s, d).select("message_id", "role"))
query("role_counts", _C + "SELECT role, count(*) AS messages, count(DISTINCT sender) AS senders FROM n GROUP BY 1 UNION ALL SELECT 'SYSTEM_EVENT', (SELECT count(*) FROM c WHERE r = 'system') + (SELECT count(DISTINCT conv_id) FROM c), 0")(lambda s, d: roles.role_counts(roled(s, d)))


# Checks and text figures, over the chat with planted faults
query(
    "sender_stats",
    X + """SELECT sender, count(*) AS message_count, count(*) FILTER (trim(text) <> '') AS text_message_count, count(*) FILTER (attached) AS attachment_message_count,
  epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM xn GROUP BY 1""",
)(lambda s, d: profile.sender_stats(faulted(s, d)).withColumns({"first_us": F.unix_micros("first_ts"), "last_us": F.unix_micros("last_ts")}).drop("first_ts", "last_ts"))
query("duplicate_ids", X + "SELECT message_id, count(*) AS n FROM x GROUP BY 1 HAVING count(*) > 1")(lambda s, d: checks.duplicate_ids(faulted(s, d)))
query("duplicate_keys", X + "SELECT source_file, message_id, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: checks.duplicate_keys(faulted(s, d)))
query(
    "chronology_violations",
    X + ", o AS (SELECT message_id, epoch_us(ts) AS us, epoch_us(lag(ts) OVER (ORDER BY row_idx)) AS previous_us FROM xn) SELECT * FROM o WHERE us < previous_us",
)(lambda s, d: checks.chronology_violations(faulted(s, d)).select("message_id", F.unix_micros("ts").alias("us"), F.unix_micros("previous_ts").alias("previous_us")))
query("utc_offsets", X + "SELECT offset_s AS utc_offset_s, count(*) AS n FROM xn GROUP BY 1")(lambda s, d: checks.offsets(faulted(s, d)))
query("empty_messages", X + "SELECT source_file, message_id FROM xn WHERE trim(text) = '' AND NOT attached")(lambda s, d: checks.empty_messages(faulted(s, d)))
query(
    "message_summary",
    X + """SELECT count(*) AS total_records, count(*) FILTER (NOT service) AS normal_messages, count(*) FILTER (service) AS service_messages,
  count(*) FILTER (trim(text) <> '') AS text_records_including_service, count(*) FILTER (NOT service AND trim(text) <> '') AS normal_text_messages,
  count(*) FILTER (attached AND trim(text) = '') AS attachment_only_messages, count(DISTINCT sender) AS distinct_sender_names FROM x""",
)(lambda s, d: checks.summary(faulted(s, d)))
query("attachment_types", X + "SELECT type, count(*) AS n FROM (SELECT unnest(CASE row_idx % 10 WHEN 3 THEN ['photo'] ELSE ['photo', 'file'] END) AS type FROM xn WHERE attached) GROUP BY 1")(
    lambda s, d: checks.attachment_types(faulted(s, d))
)
query(
    "attachment_extensions",
    X + "SELECT ext, count(*) AS n FROM (SELECT unnest(CASE row_idx % 10 WHEN 3 THEN ['.jpg'] ELSE ['.jpg', '.gz'] END) AS ext FROM xn WHERE attached) GROUP BY 1",
)(lambda s, d: faulted(s, d).select(F.explode("attachments.path").alias("path")).groupBy(tx.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n")))
_BLANKED = r"regexp_replace(text, '(?i)(https?://|www\.)[^\s]+', '', 'g')"
query(
    "question_marks",
    X + f"SELECT row_idx, contains({_BLANKED}, '?') OR contains(text, '？') AS question_mark FROM xn",
)(lambda s, d: faulted(s, d).where("message_type = 'message'").select("row_idx", tx.question_mark(F.col("text")).alias("question_mark")))
query(
    "question_markers",
    X + f"SELECT row_idx, array_to_string(list_filter({tx.QUESTION_MARKERS!r}, lambda q: contains({_BLANKED}, q)), ',') AS hits FROM xn",
)(lambda s, d: faulted(s, d).where("message_type = 'message'").select("row_idx", F.array_join(tx.question_hits(F.col("text")), ",").alias("hits")))
_MASKED = r"""regexp_replace(regexp_replace(regexp_replace(text, '(https?://|www\.)[^\s<>]+', '[URL]', 'g'), '[a-z]+@example\.com', '[EMAIL]', 'g'), '10\.0\.0\.7', '[IP]', 'g')"""
#: What each profile makes of the planted texts that only some of them mask.
_PLANTED = {"call +886 912 345 678 now": ("call [PHONE_CANDIDATE] now",) * 3 + ("call [PHONE_OR_ID] now",) * 2, "ask @handle_name or bob77 then": (None, None, None, "ask [HANDLE] or [IDENTIFIER] then", None), "帳號：abc_99 ok": (None, None, None, "帳號：[ACCOUNT] ok", "帳號：[ACCOUNT] ok")}
_PROFILES = ("profile", "segmentation", "singles", "roles", "reconstruction")


def _masked(profile: str) -> str:
    """SQL of a faulted text as a profile masks it."""
    some = [(t, m[_PROFILES.index(profile)]) for t, m in _PLANTED.items()]
    cases = " ".join(f"WHEN text = '{t}' THEN '{v}'" for t, v in some if v)
    return f"CASE {cases} WHEN text = 'my token: abcd1234efgh9999 is set' THEN 'my token: [REDACTED] is set' ELSE {_MASKED} END"


for _p in _PROFILES:
    query(f"redacted_text_{_p}", X + f"SELECT row_idx, {_masked(_p)} AS text FROM xn")(lambda s, d, p=_p: faulted(s, d).where("message_type = 'message'").select("row_idx", tx.redact(F.col("text"), p).alias("text")))
    query(f"redacted_documents_{_p}")(lambda s, d, p=_p: documents(s, d).select("doc_id", tx.redact(F.col("text"), p).alias("text")))
_TEMPLATE = f"trim(regexp_replace(regexp_replace({_masked('roles')}, '[0-9]+', '[NUMBER]', 'g'), '\\s+', ' ', 'g'))"
query("templates", X + f"SELECT {_TEMPLATE} AS template, count(*) AS n FROM xn GROUP BY 1")(
    lambda s, d: faulted(s, d).where("message_type = 'message'").groupBy(tx.template(F.col("text")).alias("template")).agg(F.count("*").alias("n"))
)
query(
    "sender_evidence",
    X + f""", c AS (SELECT text, count(*) AS k FROM xn WHERE sender = 'u1' GROUP BY 1), t AS (SELECT count(*) FILTER (k > 1) AS exact_duplicate_groups,
    CAST(coalesce(sum(k) FILTER (k > 1), 0) AS BIGINT) AS messages_in_exact_duplicate_groups, CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS duplicate_occurrences_beyond_first FROM c)
SELECT count(*) AS message_count, count(DISTINCT text) AS distinct_exact_texts, count(DISTINCT {_TEMPLATE}) AS normalized_template_count,
  count(*) FILTER (starts_with(ltrim(text), '✅')) AS checkmark_prefix_count, count(*) FILTER (starts_with(ltrim(text), '⚠')) AS warning_or_failure_prefix_count,
  count(*) FILTER (contains(text, chr(10))) AS multiline_count, count(*) FILTER (regexp_matches(text, '(?m)^[^\n]{{1,24}}[:：]')) AS colon_field_candidate_count,
  any_value(t.exact_duplicate_groups) AS exact_duplicate_groups, any_value(t.messages_in_exact_duplicate_groups) AS messages_in_exact_duplicate_groups,
  any_value(t.duplicate_occurrences_beyond_first) AS duplicate_occurrences_beyond_first FROM xn, t WHERE sender = 'u1'""",
)(lambda s, d: roles.evidence(faulted(s, d), "u1"))
query("sender_hours", X + "SELECT hour(ts + to_seconds(offset_s)) AS hour, count(*) AS n FROM xn WHERE sender = 'u1' GROUP BY 1")(lambda s, d: roles.hours(faulted(s, d), "u1"))
query(
    "sender_top_texts",
    X + "SELECT text AS value, count(*) AS n, min(row_idx) AS first_row FROM xn WHERE sender = 'u1' AND row_idx % 20 NOT IN (1, 2, 6, 7, 8, 13, 15, 17) GROUP BY 1 ORDER BY n DESC, first_row LIMIT 8",
)(lambda s, d: roles.top_values(faulted(s, d).where("row_idx % 20 not in (1, 2, 6, 7, 8, 13, 15, 17)"), "u1", "text", 8))
query("sender_top_templates", X + f"SELECT {_TEMPLATE} AS value, count(*) AS n, min(row_idx) AS first_row FROM xn WHERE sender = 'u1' GROUP BY 1 ORDER BY n DESC, first_row LIMIT 8")(
    lambda s, d: roles.top_values(faulted(s, d), "u1", "template", 8)
)
query(
    "message_pii_counts",
    X + r"""SELECT count(*) FILTER (regexp_matches(text, '(https?://|www\.)')) AS url, count(*) FILTER (contains(text, '@example.com')) AS email,
  count(*) FILTER (contains(text, '+886')) AS phone_candidate, count(*) FILTER (contains(text, '10.0.0.7')) AS ip_candidate, count(*) FILTER (contains(text, 'token:')) AS credential_candidate,
  count(*) FILTER (regexp_matches(text, '(https?://|www\.)') OR contains(text, '@example.com') OR contains(text, '+886')) AS url_email_or_phone FROM xn""",
)(lambda s, d: profile.pii_counts(faulted(s, d).where("message_type = 'message'")))
query("aba_triples", M + ", o AS (SELECT sender, ts, lag(sender) OVER w AS s1, lag(sender, 2) OVER w AS s2, lag(ts, 2) OVER w AS t2 FROM n WINDOW w AS (ORDER BY row_idx)) SELECT count(*) FILTER (s2 = sender AND s1 <> sender AND epoch_us(ts) - epoch_us(t2) <= 600000000) AS aba_triples FROM o")(
    lambda s, d: profile.aba_triples(m(s, d))
)
query(
    "tumbling_5m_activity",
    A + """, w5 AS (SELECT epoch_us(ts) // 300000000 AS b, count(*) AS n, count(DISTINCT sender) AS s, count(DISTINCT root_id) AS r FROM a GROUP BY 1)
SELECT count(*) AS active_windows, count(*) FILTER (n >= 3) AS busy_windows, count(*) FILTER (n >= 3 AND s >= 3) AS three_sender_windows,
  count(*) FILTER (n >= 3 AND s >= 3 AND r >= 2) AS multi_root_windows FROM w5""",
)(lambda s, d: profile.tumbling_activity(m(s, d), graph.ancestors(m(s, d))))
query("sender_aliases", M + "SELECT sender, 'Sender ' || lpad(CAST(row_number() OVER (ORDER BY sender) AS VARCHAR), 2, '0') AS alias FROM (SELECT DISTINCT sender FROM n)")(lambda s, d: profile.sender_aliases(m(s, d)))

# Personal data in documents: patterns that consume their boundaries stand for look-around
_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(text, '(?i)(https?://|www\.)[^\s<>]+', ' ', 'g'), '(?i)[\p{L}\p{N}_.+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+', ' ', 'g'),
  '(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}($|[^0-9.])', ' ', 'g')"""
_PLAIN = rf"regexp_replace(regexp_replace({_PLAIN}, '(?i)\b[0-9a-f]{{8}}-([0-9a-f]{{4}}-){{3}}[0-9a-f]{{12}}\b', ' ', 'g'), '\b[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}\b', ' ', 'g')"
_PHONES = rf"len(list_filter(regexp_extract_all({_PLAIN}, '(^|[^\p{{L}}\p{{N}}_.])(\+?[0-9][0-9 ()-]{{6,}}[0-9])($|[^\p{{L}}\p{{N}}_.])', 2), lambda z: len(regexp_replace(z, '[^0-9]', '', 'g')) BETWEEN 8 AND 15))"
_PII = {
    "url": r"regexp_matches(text, '(?i)(https?://|www\.)[^\s<>]')", "email": r"regexp_matches(text, '(?i)[\p{L}\p{N}_.+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+')", "phone_candidate": f"{_PHONES} > 0",
    "ip_candidate": r"regexp_matches(text, '(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}($|[^0-9.])')",
    "credential_candidate": r"regexp_matches(text, '(?i)\b(token|hash|password|passwd|secret|api[_ -]?key)\b\s*[:=：]\s*[^\s&<>]')",
}
query(
    "pii_flags",
    "WITH f AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _PII.items()) + " FROM (SELECT coalesce(text, '') AS text FROM documents)) SELECT " + ", ".join(f"count(*) FILTER ({k}) AS {k}" for k in _PII) + ", count(*) FILTER (url OR email OR phone_candidate) AS url_email_or_phone FROM f",
)(lambda s, d: profile.pii_counts(documents(s, d)))
query("phone_candidates", f"SELECT * FROM (SELECT doc_id, {_PHONES} AS n FROM documents) WHERE n > 0")(lambda s, d: profile.phone_rows(documents(s, d), "doc_id"))

def _partner_sql() -> str:
    pairs = {"re": "SELECT sender AS f, parent_sender AS t FROM q WHERE parent_id IS NOT NULL AND NOT parent_service", "ad": "SELECT b AS f, sender AS t FROM o WHERE epoch_us(ts) - epoch_us(bt) <= 600000000", "sw": "SELECT b AS f, sender AS t FROM g WHERE b <> sender"}
    ways = {"out": "SELECT f AS sender, t AS other FROM {0}", "in": "SELECT t AS sender, f AS other FROM {0}", "both": "SELECT f AS sender, t AS other FROM {0} UNION ALL SELECT t, f FROM {0}"}
    lists = [("most_replied_to", "re", "out"), ("most_replied_by", "re", "in"), ("reply_interactions_other_senders", "re", "both"), ("adjacency_interactions_other_senders", "ad", "both"), ("same_topic_switches_to", "ad", "out"), ("same_topic_switches_from", "ad", "in"), ("global_switches_to", "sw", "out"), ("global_switches_from", "sw", "in")]
    out = "".join(f", {k} AS ({v})" for k, v in pairs.items())
    for name, table, way in lists:
        out += f", {name}_ AS (SELECT sender, string_agg(other || ':' || n, ',' ORDER BY n DESC, other) AS {name} FROM (SELECT sender, other, count(*) AS n FROM ({ways[way].format(table)}) WHERE sender <> other GROUP BY 1, 2) GROUP BY 1)"
    return out, [name for name, _, _ in lists]


_LISTS, _NAMES = _partner_sql()
query(
    "sender_profiles",
    A + XK + f""",
q AS (SELECT xk.*, p.reply_to, p.parent_id, p.parent_service, p.parent_sender, a.topic, CAST(length(xk.text) AS DOUBLE) AS len, trim(xk.text) <> '' AS has, regexp_matches(xk.text, '(?i)(https?://|www\\.)') AS url,
    CASE xk.row_idx % 10 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS items FROM xk JOIN p USING (message_id) JOIN a USING (message_id)),
o AS (SELECT sender, ts, lag(sender) OVER w AS b, lag(ts) OVER w AS bt FROM a WHERE topic IS NOT NULL WINDOW w AS (PARTITION BY topic ORDER BY ts, row_idx)),
g AS (SELECT sender, lag(sender) OVER (ORDER BY row_idx) AS b FROM n){_LISTS},
wide AS (SELECT sender, count(*) AS message_count, count(*) FILTER (has) AS text_message_count, count(*) FILTER (items > 0) AS attachment_message_count, CAST(sum(items) AS BIGINT) AS attachment_item_count,
    epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(DISTINCT CAST(ts + to_seconds(offset_s) AS DATE)) AS active_days, count(reply_to) AS reply_sent_count,
    count(*) FILTER (NOT parent_service) AS reply_sent_to_normal_count, count(*) FILTER (parent_service) AS reply_sent_to_system_count, count(*) FILTER (reply_to IS NOT NULL AND parent_id IS NULL) AS reply_sent_unresolved_count,
    count(*) FILTER (NOT parent_service AND parent_sender = sender) AS self_reply_count, avg(len) AS mean_text_length_including_empty, median(len) AS median_text_length_including_empty,
    avg(len) FILTER (has) AS mean_nonempty_text_length, median(len) FILTER (has) AS median_nonempty_text_length, count(*) FILTER (url) AS url_message_count, count(*) FILTER (url) / count(*) AS url_message_ratio,
    count(*) FILTER (items > 0) / count(*) AS attachment_message_ratio, count(*) FILTER (contains({_BLANKED}, '?') OR contains(text, '？')) AS question_mark_message_count, count(DISTINCT topic) AS known_topic_count FROM q GROUP BY 1)
SELECT wide.*, coalesce((SELECT count(*) FROM re WHERE t = wide.sender), 0) AS reply_received_count, coalesce((SELECT count(*) FROM ad WHERE f = t AND f = wide.sender), 0) AS same_sender_topic_adjacency_count, {', '.join(_NAMES)}
FROM wide """ + " ".join(f"LEFT JOIN {n}_ USING (sender)" for n in _NAMES),
)(lambda s, d: (lambda c: roles.sender_profiles(c, graph.ancestors(c)).withColumns({n: F.array_join(F.transform(n, lambda x: F.concat(x["sender"], F.lit(":"), x["count"].cast("string"))), ",") for n in _NAMES} | {"first_us": F.unix_micros("first_ts"), "last_us": F.unix_micros("last_ts")}).drop("first_ts", "last_ts"))(texted(s, d)))
_GRAPH = M + """, u AS (SELECT least(sender, parent_sender) AS x, greatest(sender, parent_sender) AS y, CAST(count(*) AS DOUBLE) AS w FROM p WHERE parent_id IS NOT NULL AND NOT parent_service AND sender <> parent_sender GROUP BY 1, 2),
names AS (SELECT DISTINCT unnest([sender, parent_sender]) AS s FROM p WHERE parent_id IS NOT NULL AND NOT parent_service),
seat AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM names),
cuts AS (SELECT sd.c, sum(w) FILTER (((sd.c >> a.i) & 1) <> ((sd.c >> b.i) & 1)) AS cut FROM u JOIN seat a ON a.s = u.x JOIN seat b ON b.s = u.y CROSS JOIN (SELECT CAST(range AS BIGINT) AS c FROM range(0, 16)) sd GROUP BY 1)
"""
query(
    "sender_graph_figures",
    _GRAPH + "SELECT (SELECT count(*) FROM names) AS senders, (SELECT count(*) FROM u) AS edges, (SELECT sum(w) FROM u) AS total_weight, (SELECT count(*) FROM names WHERE s NOT IN (SELECT x FROM u UNION SELECT y FROM u)) AS isolated, (SELECT max(cut) FROM cuts) / (SELECT sum(w) FROM u) AS max_cut_fraction, 'exact' AS max_cut_status",
)(lambda s, d: graph.sender_graph(roles.reply_matrix(m(s, d))).select("senders", "edges", "total_weight", F.size("isolated").alias("isolated"), "max_cut_fraction", "max_cut_status"))


@query(
    "sender_graph",
    _GRAPH + """, deg AS (SELECT s, sum(w) AS d FROM (SELECT x AS s, w FROM u UNION ALL SELECT y, w FROM u) GROUP BY 1), tot AS (SELECT sum(w) AS w FROM u),
one AS (SELECT 0 AS step, list(s ORDER BY s) AS names, list(s ORDER BY s) AS lab FROM deg),
go AS (SELECT * FROM one UNION ALL SELECT step + 1, names, list_transform(lab, lambda z: CASE WHEN z = best[2] THEN best[1] ELSE z END) FROM (SELECT step, names, lab, (
    SELECT arg_max([p_, q_], (round(gain, 12), -pi, -qi)) FROM (SELECT least(ga, gb) AS p_, greatest(ga, gb) AS q_, list_position(lab, least(ga, gb)) AS pi, list_position(lab, greatest(ga, gb)) AS qi,
        sum(link) / (SELECT w FROM tot) - max(da) * max(db) / (2 * (SELECT w FROM tot) * (SELECT w FROM tot)) AS gain
      FROM (SELECT lab[i.range] AS ga, lab[j.range] AS gb, coalesce((SELECT w FROM u WHERE x = least(names[i.range], names[j.range]) AND y = greatest(names[i.range], names[j.range])), 0) AS link,
          (SELECT sum(d) FROM deg WHERE lab[list_position(names, s)] = least(lab[i.range], lab[j.range])) AS da, (SELECT sum(d) FROM deg WHERE lab[list_position(names, s)] = greatest(lab[i.range], lab[j.range])) AS db
        FROM range(1, 21) i, range(1, 21) j WHERE i.range < j.range AND j.range <= len(names) AND lab[i.range] <> lab[j.range]) GROUP BY 1, 2, 3, 4) WHERE gain > 1e-12) AS best FROM go) WHERE best IS NOT NULL),
final AS (SELECT unnest(names) AS s, unnest(lab) AS l FROM go WHERE step = (SELECT max(step) FROM go)),
inside AS (SELECT a.l, sum(w) AS w FROM u JOIN final a ON a.s = x JOIN final b ON b.s = y AND a.l = b.l GROUP BY 1), grp AS (SELECT l, sum(d) AS d, string_agg(s, ',' ORDER BY s) AS members FROM final JOIN deg USING (s) GROUP BY 1)
SELECT string_agg(members, '|' ORDER BY d DESC, members) AS communities, sum(coalesce(inside.w, 0) / tot.w - (d / (2 * tot.w)) * (d / (2 * tot.w))) AS modularity, sum(coalesce(inside.w, 0)) / any_value(tot.w) AS internal_fraction FROM grp LEFT JOIN inside USING (l), tot""",
)
def _graph(s, d):
    made = graph.sender_graph(roles.reply_matrix(m(s, d)))
    return made.select(F.array_join(F.transform("communities", lambda g: F.array_join(g, ",")), "|").alias("communities"), "modularity", "internal_fraction")


# Samples
query("uniform_sample", M + f"SELECT message_id FROM m ORDER BY md5('{sampling.SEED}:' || message_id), message_id LIMIT 100")(lambda s, d: sampling.uniform(m(s, d), "message_id").select("message_id"))
_STRATA = {"replies": "reply_to IS NOT NULL", "clicks": "text = 'click'", "starts": "reply_to IS NULL"}
query("stratified_sample", M + ",\n" + picks_sql("n", "message_id", _STRATA, 7, 50, sampling.SEED) + "SELECT k_ AS message_id, stratum FROM picks")(
    lambda s, d: sampling.stratified(m(s, d).where("message_type = 'message'"), "message_id", {k: F.expr(v) for k, v in _STRATA.items()}, 7, 50).select("message_id", "stratum")
)
_TWO = {"replies": "reply_to IS NOT NULL", "starts": "reply_to IS NULL"}
query("sample_by_sender", M + ",\n" + picks_sql("n", "message_id", _TWO, 3, 30, sampling.SEED, by="sender") + "SELECT k_ AS message_id, b_ AS sender, stratum FROM picks")(
    lambda s, d: sampling.stratified(m(s, d).where("message_type = 'message'"), "message_id", {k: F.expr(v) for k, v in _TWO.items()}, 3, 30, by=["sender"]).select("message_id", "sender", "stratum")
)
_REVIEW = {
    "question_mark": f"contains({_BLANKED}, '?') OR contains(text, '？')", "reply_to_other_sender": "NOT parent_service AND parent_sender <> sender", "replied_by_other_sender": "answered",
    "attachment_context": "attached OR beside OR target_attached", "long_100plus_chars": "length(text) >= 100", "short_20or_fewer_chars": "length(text) <= 20",
}
query(
    "sender_review_sample",
    A + XK + f""",
q AS (SELECT x.message_id, x.row_idx, x.sender, x.text, x.attached, p.parent_service, p.parent_sender, t.attached AS target_attached, CAST(x.ts + to_seconds(x.offset_s) AS DATE) AS day,
    EXISTS (SELECT 1 FROM p c WHERE c.parent_id = x.message_id AND c.sender <> x.sender) AS answered,
    coalesce(lag(x.attached) OVER w, FALSE) AND a.topic IS NOT NULL OR coalesce(lead(x.attached) OVER w, FALSE) AND a.topic IS NOT NULL AS beside
  FROM xk x JOIN p ON p.message_id = x.message_id JOIN a ON a.message_id = x.message_id LEFT JOIN xk t ON t.message_id = p.parent_id
  WINDOW w AS (PARTITION BY a.topic ORDER BY x.ts, x.row_idx)),
qt AS (SELECT * FROM q WHERE trim(text) <> ''),
days AS (SELECT sender, day, row_number() OVER (PARTITION BY sender ORDER BY md5('{sampling.SEED}:' || sender || ':' || CAST(day AS VARCHAR)), day) AS v FROM (SELECT DISTINCT sender, day FROM qt)),
firsts AS (SELECT arg_min(message_id, (md5('{sampling.SEED}:' || message_id), message_id)) AS k_, sender AS b_, 'cover' AS stratum FROM qt JOIN days USING (sender, day) WHERE v <= 8 GROUP BY sender, day),
""" + picks_sql("qt", "message_id", _REVIEW, 3, 30, sampling.SEED, by="sender", cover="SELECT * FROM firsts") + "SELECT b_ AS sender, k_ AS message_id, stratum FROM picks",
)(lambda s, d: (lambda c: roles.review_sample(c, graph.ancestors(c)))(texted(s, d)))
query("context_around_anchors", M + ", k AS (SELECT row_idx FROM m WHERE row_idx % 500 = 0) SELECT k.row_idx AS anchor, m.row_idx FROM k JOIN m ON m.row_idx BETWEEN k.row_idx - 3 AND k.row_idx + 3")(lambda s, d: sampling.around(m(s, d).select("row_idx"), m(s, d).where("row_idx % 500 = 0").select("row_idx")).select("anchor", "row_idx"))
query("lenient_page_blocks")(lambda s, d: html.lenient_counts(s.read.parquet(f"{d}/pages.parquet")))

from colloquy.plans import exported  # noqa: E402, F401  (registers the queries about exported pages)
