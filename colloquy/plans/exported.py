"""The events table written as exported pages of 40 events each, read back by both parsers; the SQL says what they should find.

Pages have date rows, joined rows, replies within and across pages, forwarded parts, attachments, entities, and
faults: rows with an unknown part, a page whose elements do not match, pages whose shell is not closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import graph
from colloquy.plans.base import M, m, query, shared
from colloquy.sources import pages as html

#: Which rows and pages have what; DuckDB and Spark read these alike.
BAD_ROW, BAD_PAGE, OPEN_PAGE = "row_idx % 173 = 5", "page % 50 = 7", "page % 10 = 3"
MARKED, FORWARDED, PHOTO, LEFT_OUT, MENTION = "row_idx % 6 = 1", "row_idx % 9 = 4", "row_idx % 10 = 3", "row_idx % 10 = 4", "row_idx % 14 = 2"


def _name(page: Column) -> Column:
    return F.when(page == 0, F.lit("messages.html")).otherwise(F.concat(F.lit("messages"), page.cast("string"), F.lit(".html")))


def export(s: SparkSession, d: str) -> DataFrame:
    """(source_file, html) of the pages."""
    rows = m(s, d).withColumn("page", F.floor(F.col("row_idx") / 40)).withColumn("target", F.col("reply_to").cast("long"))
    before = m(s, d).select((F.col("row_idx") + 1).alias("row_idx"), F.col("sender").alias("before"))
    rows = rows.join(before, "row_idx", "left")
    lit = F.lit
    if_ = lambda cond, *parts: F.when(F.expr(cond) if isinstance(cond, str) else cond, F.concat(*parts)).otherwise(lit(""))
    time = F.date_format("ts", "dd.MM.yyyy HH:mm:ss")
    joined = F.coalesce(F.col("before") == F.col("sender"), lit(False)) & (F.col("row_idx") % 40 != 0)
    away = F.greatest(F.floor(F.col("target") / 40), F.lit(0))  # what is older than the export would be on its first page
    reply = if_(F.col("target").isNotNull(), lit('<div class="reply_to details">In reply to <a href="'), F.when(away == F.col("page"), lit("")).otherwise(_name(away)), lit("#go_to_message"), F.col("target").cast("string"), lit('">this</a></div>'))
    name = F.when(joined, lit("")).otherwise(F.concat(lit('<div class="from_name"> '), "sender", lit(" </div>")))
    forward = if_(FORWARDED, lit('<div class="forwarded body"><div class="from_name">Far <span class="date details" title="'), time, lit(' UTC+00:00"> then</span></div><div class="text">forwarded '), F.col("message_id"), lit("</div></div>"))
    photo = if_(PHOTO, lit('<div class="media_wrap clearfix"><a class="photo_wrap clearfix pull_left" href="photos/p'), F.col("message_id"), lit('.JPG"></a></div>'))
    left = if_(LEFT_OUT, lit('<div class="media_wrap clearfix"><div class="media clearfix media_file"><div class="title bold">plan</div><div>Not included, change data exporting settings to download.</div></div></div>'))
    poll = if_(BAD_ROW, lit('<div class="poll">?</div>'))
    text = F.concat("text", if_(MARKED, lit(" &amp; <strong>bold</strong><br>line")), if_(MENTION, lit(' <a href="" onclick="return ShowMentionName()">@x</a> 🙂')))
    ordinary = F.concat(
        lit('<div class="message default clearfix'), F.when(joined, lit(" joined")).otherwise(lit("")), lit('" id="message'), F.col("message_id"), lit('"><div class="body"><div class="pull_right date details" title="'), time, lit(' UTC+00:00">t</div>'),
        name, reply, photo, left, poll, forward, lit('<div class="text">'), text, lit("</div></div></div>"),
    )
    day = F.concat(lit('<div class="message service" id="message-'), F.col("page").cast("string"), lit('"><div class="body details">'), F.date_format("date_context", "d MMMM yyyy"), lit("</div></div>"))
    service = F.concat(day, lit('<div class="message service" id="message'), F.col("message_id"), lit('"><div class="body details"><a href="#">'), F.col("text"), lit("</a></div></div>"))
    piece = F.when(F.col("message_type") == "service", service).otherwise(ordinary)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", piece.alias("piece")))), lambda x: x["piece"]), "\n")
    head, tail = '<html><body><div class="page_wrap"><div class="page_body chat_page"><div class="history">', "</div></div></div></body></html>"
    whole = F.concat(lit(head), "body", F.when(F.expr(BAD_PAGE), lit("<div><span></div>")).otherwise(lit("")), F.when(F.expr(OPEN_PAGE), lit("")).otherwise(lit(tail)))
    return rows.groupBy("page").agg(body.alias("body")).select(_name(F.col("page")).alias("source_file"), whole.alias("html"))


_PAGE = "CASE WHEN row_idx < 40 THEN 'messages.html' ELSE 'messages' || CAST(row_idx // 40 AS VARCHAR) || '.html' END"
#: x: all rows with page, joined, bad; good: what the strict parser should give; lost: joined rows without a sender.
E = (
    M
    + f""",
l AS (SELECT *, row_idx // 40 AS page, NOT service AND coalesce(lag(sender) OVER (ORDER BY row_idx) = sender, FALSE) AND row_idx % 40 <> 0 AS joined, NOT service AND {BAD_ROW} AS bad FROM m),
y AS (SELECT *, {_PAGE} AS source_file, max(CASE WHEN bad THEN row_idx END) OVER w AS last_bad, max(CASE WHEN NOT joined AND NOT bad THEN row_idx END) OVER w AS last_named
  FROM l WINDOW w AS (PARTITION BY page ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x AS (SELECT *, joined AND NOT bad AND coalesce(last_bad, -1) > coalesce(last_named, -1) AS lost, text || CASE WHEN NOT service AND {MARKED} THEN ' & bold' || chr(10) || 'line' ELSE '' END
    || CASE WHEN NOT service AND {MENTION} THEN ' @x 🙂' ELSE '' END AS own FROM y),
fine AS (SELECT * FROM x WHERE NOT ({BAD_PAGE})),
good AS (SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, message_id, source_file, CASE WHEN service THEN 'service' ELSE 'message' END AS message_type,
    epoch_us(date_trunc('second', ts)) AS us, CASE WHEN NOT service THEN 0 END AS utc_offset_s, date_context, sender, CASE WHEN NOT service THEN joined END AS sender_inherited,
    CASE WHEN NOT service AND {FORWARDED} THEN own || chr(10) || 'forwarded ' || message_id ELSE own END AS text, CASE WHEN NOT service THEN own END AS own_text, reply_to,
    CASE WHEN reply_to IS NOT NULL THEN {_PAGE.replace('row_idx', 'CAST(reply_to AS BIGINT)')} END AS reply_to_source_file,
    CASE WHEN service THEN NULL WHEN {FORWARDED} THEN 1 ELSE 0 END AS forwards, CASE WHEN service THEN NULL WHEN {PHOTO} THEN 'photo' WHEN {LEFT_OUT} THEN 'file' END AS attachment_type,
    CASE WHEN NOT service AND {PHOTO} THEN 'photos/p' || message_id || '.JPG' END AS attachment_path FROM fine WHERE NOT bad AND NOT lost)
"""
)


@shared
def _read(s, d):
    return html.messages(graph.persisted(html.parsed(export(s, d))))


_PLAIN = ["row_idx", "message_id", "source_file", "message_type", "utc_offset_s", "date_context", "sender", "sender_inherited", "text", "own_text", "reply_to", "reply_to_source_file", "attachment_type", "attachment_path"]
query("export_messages", E + "SELECT * FROM good")(lambda s, d: _read(s, d)[0].select(*_PLAIN, F.unix_micros("ts").alias("us"), F.size("forwarded").alias("forwards")))
query(
    "export_errors",
    E + f"SELECT source_file, 'message' || message_id AS message_id, 'row' AS kind FROM fine WHERE bad UNION ALL SELECT source_file, message_id, 'sender' FROM fine WHERE lost UNION ALL SELECT DISTINCT source_file, NULL, 'page' FROM x WHERE {BAD_PAGE}",
)(lambda s, d: _read(s, d)[1].select("source_file", "message_id", F.when(F.col("message_id").isNull(), "page").when(F.col("message_id").startswith("message"), "row").otherwise("sender").alias("kind")))
query("export_warnings", E + f"SELECT DISTINCT source_file FROM fine WHERE {OPEN_PAGE}")(lambda s, d: _read(s, d)[2].where("message_id is null").select("source_file"))
query(
    "export_page_report",
    E
    + f"""SELECT source_file, count(*) + 1 AS html_message_blocks, 1 AS date_separators, count(*) FILTER (NOT service AND NOT bad) AS normal_messages, count(*) FILTER (service) AS service_messages,
  count(*) FILTER (joined AND NOT bad) AS joined, count(*) FILTER (NOT service AND NOT bad AND {FORWARDED}) AS forwarded_messages, count(*) FILTER (bad) AS errors FROM fine GROUP BY 1
UNION ALL SELECT DISTINCT source_file, 1, 0, 0, 0, 0, 0, 1 FROM x WHERE {BAD_PAGE}""",
)(lambda s, d: html.page_report(html.parsed(export(s, d))))
query(
    "strict_page_verdicts",
    E + f"SELECT source_file, {BAD_PAGE} AS rejected FROM x GROUP BY 1, 2 UNION ALL SELECT CAST(page_id AS VARCHAR), TRUE FROM pages",
)(lambda s, d: html.strict_verdicts(export(s, d).union(s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").cast("string"), "html"))))
_TYPES = f"""array_to_string(list_filter(['normal', CASE WHEN joined THEN 'joined' END, CASE WHEN reply_to IS NOT NULL THEN 'reply' END, CASE WHEN {FORWARDED} THEN 'forwarded' END, CASE WHEN {PHOTO} OR {LEFT_OUT} THEN 'media' END,
  CASE WHEN {PHOTO} OR {LEFT_OUT} THEN 'text_attachment' END, CASE WHEN {MENTION} THEN 'mention' END, CASE WHEN {MENTION} THEN 'emoji' END, CASE WHEN {MARKED} OR {FORWARDED} THEN 'multiline' END], lambda t: t IS NOT NULL), ',')"""
query("lenient_rows", E + f"SELECT source_file, message_id, CASE WHEN service THEN 'service' ELSE {_TYPES} END AS types, sender FROM x")(
    lambda s, d: html.lenient(export(s, d)).where("not date_row").select("source_file", "message_id", F.array_join("types", ",").alias("types"), "sender")
)


@shared
def _compared(s, d):
    raw = graph.persisted(html.lenient(export(s, d)))
    rows = graph.persisted(_read(s, d)[0])
    return raw, rows, graph.persisted(html.reconciled(raw, rows))


_PASS = ", ".join(f"{f}_match" for f in html.FIELDS)
query("reconciled_messages", E + ", ok AS (SELECT x.source_file, x.message_id, g.message_id IS NOT NULL AS hit FROM x LEFT JOIN good g ON g.message_id = x.message_id) SELECT source_file, message_id, TRUE AS in_raw, hit AS in_parsed, " + ", ".join(f"hit AS {f}_match" for f in html.FIELDS) + ", hit AS overall_pass FROM ok")(
    lambda s, d: _compared(s, d)[2].select("source_file", "message_id", "in_raw", "in_parsed", *[f"{f}_match" for f in html.FIELDS], "overall_pass")
)
query(
    "validation_summary",
    E
    + f""", r AS (SELECT x.*, t.message_id AS hit, {_PAGE.replace('row_idx', 'CAST(x.reply_to AS BIGINT)')} AS to_file FROM x LEFT JOIN x t ON t.message_id = x.reply_to WHERE x.reply_to IS NOT NULL)
SELECT (SELECT count(*) + count(DISTINCT page) FROM x) AS raw_blocks, (SELECT count(DISTINCT page) FROM x) AS date_separators, (SELECT count(*) FROM good) AS parsed_messages, 0 AS duplicate_parsed_ids, 0 AS normal_missing_senders,
  (SELECT count(*) FROM x) - (SELECT count(*) FROM good) AS keys_of_one_side, """
    + ", ".join(f"(SELECT count(*) FROM x) - (SELECT count(*) FROM good) AS {f}_mismatches" for f in html.FIELDS)
    + f""", (SELECT count(*) FROM good) AS rows_that_pass, (SELECT count(*) FROM r) AS total_reply_messages, (SELECT count(hit) FROM r) AS valid_reply_target, (SELECT count(*) - count(hit) FROM r) AS missing_target,
  (SELECT count(*) FROM r WHERE source_file <> to_file) AS cross_file_reply, (SELECT count(*) FROM x WHERE NOT service AND ({PHOTO} OR {LEFT_OUT})) AS attachment_count, 0 AS negative_time_gaps""",
)(lambda s, d: html.validation_summary(*_compared(s, d)))


@query("parser_sample_kinds")
def _sample(s, d):
    """How many rows each kind has in the parser's sample."""
    _, _, compared = _compared(s, d)
    return html.parser_sample(compared).groupBy("stratum").agg(F.count("*").alias("n"))
