"""What the query modules share: the table of queries, the chats that the driver's tables are read as, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.operators import roles
from colloquy.sources import messages as src

#: Whether queries of one session share the tables they have in common. Tests do; a query that is timed should not.
SHARE = False
_SHARED: dict = {}


def shared(f: Callable) -> Callable:
    """f(spark, sf_dir), remembered for each session and folder while SHARE is set."""

    def made(spark: SparkSession, sf_dir: str):
        if not SHARE:
            return f(spark, sf_dir)
        key = (f.__module__, f.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _SHARED:
            _SHARED[key] = f(spark, sf_dir)
        return _SHARED[key]

    return made


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: M in SQL. n is ordinary messages, p adds the row replied to, a the ancestors.
M = """WITH RECURSIVE e AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
m AS (SELECT event_id AS row_idx, CAST(event_id AS VARCHAR) AS message_id, event_id % 40 = 0 AS service, CASE WHEN event_id % 40 <> 0 THEN ts END AS ts,
  CASE WHEN event_id % 40 <> 0 THEN 'u' || CAST(user_id % 4 AS VARCHAR) END AS sender, CASE WHEN event_id % 40 = 0 THEN CAST(ts AS DATE) END AS date_context,
  CASE WHEN event_id % 40 = 0 THEN 'bot created topic ' || CAST(event_id AS VARCHAR) ELSE event_type END AS text,
  CAST(CASE WHEN event_id % 40 = 0 THEN NULL WHEN k % 3 = 0 AND k > 0 THEN event_id - k WHEN k % 3 = 1 THEN event_id - event_id % 40 END AS VARCHAR) AS reply_to FROM e),
n AS (SELECT * FROM m WHERE NOT service),
p AS (SELECT n.*, t.message_id AS parent_id, t.service AS parent_service, t.sender AS parent_sender, t.ts AS parent_ts FROM n LEFT JOIN m t ON n.reply_to = t.message_id)"""
#: Ancestors in SQL: the first ordinary message of each chain, and what it replies to.
A = M + """,
w AS (SELECT message_id, message_id AS head, 0 AS steps FROM p WHERE parent_id IS NULL OR parent_service
  UNION ALL SELECT p.message_id, w.head, w.steps + 1 FROM p JOIN w ON p.parent_id = w.message_id WHERE NOT p.parent_service),
a AS (SELECT w.message_id, w.head, n.row_idx, n.sender, n.ts, h.reply_to IS NOT NULL AND h.parent_id IS NULL AS lost, h.parent_service IS TRUE AS rooted,
  w.steps + CASE WHEN h.parent_service THEN 1 ELSE 0 END AS depth, coalesce(h.parent_id, h.reply_to, w.head) AS root_id, CASE WHEN h.parent_service THEN h.parent_id END AS topic
  FROM w JOIN p h ON w.head = h.message_id JOIN n ON w.message_id = n.message_id),
comp AS (SELECT head, min(row_idx) AS component_row, count(*) AS component_size FROM a GROUP BY head)"""


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def m(spark: SparkSession, d: str) -> DataFrame:
    return src.messages_from_events(spark, d)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def roled(spark: SparkSession, d: str) -> DataFrame:
    c = src.messages_from_conversations(spark, d)
    return roles.with_roles(c, src.conversation_roles(c))


#: M with a role for each sender, so that all kinds of evidence for a merge occur.
M_ROLES = {"u0": "AGENT", "u1": "USER", "u2": "USER", "u3": "BOT"}


def m_roled(spark: SparkSession, d: str) -> DataFrame:
    return roles.with_roles(m(spark, d), spark.createDataFrame(list(M_ROLES.items()), "sender string, role string"))


def faulted(spark: SparkSession, d: str) -> DataFrame:
    return src.messages_with_faults(spark, d)


#: The same faults in SQL: x has all rows, xn ordinary ones; offset_s and attached say what else they have.
_CASES = " ".join(f"WHEN {k} THEN {v}" for k, v in src.FAULT_TEXTS.items())
X = (
    M
    + f""",
x AS (SELECT row_idx, CASE WHEN row_idx % 97 = 13 THEN CAST(row_idx - 1 AS VARCHAR) ELSE message_id END AS message_id,
    CASE WHEN row_idx % 89 = 2 THEN 'other' ELSE 'events' END AS source_file, service, CASE WHEN row_idx % 101 = 7 THEN ts - INTERVAL 1 DAY ELSE ts END AS ts, sender, reply_to,
    CASE WHEN service THEN NULL WHEN row_idx % 50 = 3 THEN 7200 ELSE 0 END AS offset_s,
    CASE WHEN service THEN text ELSE CASE row_idx % 20 {_CASES} ELSE text END END AS text, NOT service AND row_idx % 10 IN (3, 4) AS attached FROM m),
xn AS (SELECT * FROM x WHERE NOT service)
"""
)


def texted(spark: SparkSession, d: str) -> DataFrame:
    """m with the texts, offsets and attachments of faulted, but ids, files and times as they are."""
    own = m(spark, d).select("row_idx", "message_id", "source_file", "ts")
    return src.shaped(faulted(spark, d).drop("message_id", "source_file", "ts").join(own, "row_idx"))


#: The same in SQL; it follows A.
XK = f""",
xk AS (SELECT row_idx, message_id, ts, sender, CASE WHEN row_idx % 50 = 3 THEN 7200 ELSE 0 END AS offset_s,
    CASE row_idx % 20 {_CASES} ELSE text END AS text, row_idx % 10 IN (3, 4) AS attached FROM n)
"""
