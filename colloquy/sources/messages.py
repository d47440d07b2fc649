"""The message table: its schema, its JSON Lines form, and views of other tables that have its shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _B, _I, _L, _T, _D = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.TimestampType(), T.DateType()
_REPLY = _struct(message_id=_S, source_file=_S, href=_S)
MESSAGE = _struct(
    row_idx=_L, message_id=_S, source_file=_S, message_type=_S, datetime=_S, ts=_T, utc_offset_s=_I, date_context=_D, sender=_S, sender_inherited=_B, text=_S, own_text=_S, reply_to=_S, reply_to_source_file=_S,
    forwarded=T.ArrayType(_struct(sender=_S, datetime=_S, reply=_REPLY, text=_S)),
    attachments=T.ArrayType(_struct(type=_S, path=_S, title=_S, html_class=_S, reference_exists=_B, local_exists=_B, availability=_S)),
    attachment_type=_S, attachment_path=_S,
)
#: A service row whose text has this opens a topic (a fixed value of the export format).
TOPIC_MARK = " created topic "


def shaped(df: DataFrame) -> DataFrame:
    """df with exactly the columns of MESSAGE; those it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MESSAGE.fields])


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a JSON Lines file or folder; rows without row_idx are numbered by file name, then line.

    Blank lines are no rows. A U+2028 or U+0085 within a text does not end a line.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    raw = spark.read.schema(MESSAGE).json(path).select("*", *place).where(F.col("message_id").isNotNull())
    # Spark reads large splits first, so its own numbers do not follow the files: a split's rows come after those of the splits before it
    sizes = raw.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    skip = sizes.select("_file", "_block", F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_skip"))
    nth = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_line")) - 1
    numbered = raw.withColumn("_nth", nth).join(skip, ["_file", "_block"]).withColumn("row_idx", F.coalesce("row_idx", (F.col("_skip") + F.col("_nth")).cast("long")))
    return numbered.select(*MESSAGE.fieldNames()).withColumns({"ts": F.coalesce("ts", F.to_timestamp("datetime")), "utc_offset_s": F.coalesce("utc_offset_s", offset_seconds(F.col("datetime")))})


def offset_seconds(iso: F.Column) -> F.Column:
    """Seconds east of UTC of an ISO time that ends in +HH:MM or -HH:MM."""
    part = lambda k: F.regexp_extract(iso, r"([+-])(\d\d):(\d\d)$", k)
    return F.when(part(1) != "", F.when(part(1) == "-", -1).otherwise(1) * (part(2).cast("int") * 3600 + part(3).cast("int") * 60))


def replaced(df: DataFrame, path: str) -> None:
    """Writes df as JSON Lines beside path and then puts it in path's place, so that an old output stays until the new one is whole."""
    spark, new = df.sparkSession, path.rstrip("/") + "-unfinished"
    df.write.mode("overwrite").json(new)
    jvm = spark.sparkContext._jvm
    at, to = (jvm.org.apache.hadoop.fs.Path(x) for x in (new, path))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(to, True)
    if not fs.rename(at, to):
        raise OSError(f"{new} could not be moved to {path}")


def write_messages(messages: DataFrame, path: str, errors: DataFrame | None = None) -> bool:
    """Writes JSON Lines, whole or not at all; nothing if there are errors."""
    if errors is not None and not errors.isEmpty():
        return False
    replaced(messages, path)
    return True


def messages_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a chat: each 40th event opens a topic, four senders, replies by the event's own number k.

    k divisible by 3 replies k events back, remainder 1 to the topic's row, remainder 2 to nothing.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    service = F.col("event_id") % 40 == 0
    reply = F.when(service, None).when((F.col("k") % 3 == 0) & (F.col("k") > 0), F.col("event_id") - F.col("k")).when(F.col("k") % 3 == 1, F.col("event_id") - F.col("event_id") % 40)
    return shaped(
        e.select(
            F.col("event_id").alias("row_idx"),
            F.col("event_id").cast("string").alias("message_id"),
            F.lit("events").alias("source_file"),
            F.when(service, "service").otherwise("message").alias("message_type"),
            F.when(~service, F.col("ts")).alias("ts"),
            F.when(~service, F.lit(0)).alias("utc_offset_s"),
            F.when(service, F.to_date("ts")).alias("date_context"),
            F.when(~service, F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))).alias("sender"),
            F.when(service, F.concat(F.lit("bot created topic "), F.col("event_id").cast("string"))).otherwise(F.col("event_type")).alias("text"),
            reply.cast("string").alias("reply_to"),
        )
    )


def messages_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as a chat with one topic for each conversation and a message a minute.

    A system turn is a service row; each conversation starts with a service row that opens its topic, and a
    message replies to the turn before it, the first to that row. Senders are role and conv_id % 3.
    """
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    base = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 7200 + F.col("turn") * 60)
    service = F.col("role") == "system"
    rows = c.select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("row_idx"),
        F.when(service, "service").otherwise("message").alias("message_type"),
        F.when(~service, base).alias("ts"),
        F.when(~service, F.concat("role", F.lit("_"), (F.col("conv_id") % 3).cast("string"))).alias("sender"),
        "text",
        F.when(~service, (F.col("conv_id") * 1000 + F.col("turn")).cast("string")).alias("reply_to"),
    )
    roots = c.select("conv_id").distinct().select((F.col("conv_id") * 1000).alias("row_idx"), F.lit("service").alias("message_type"), F.concat(F.lit("desk created topic "), F.col("conv_id").cast("string")).alias("text"))
    both = rows.unionByName(roots, allowMissingColumns=True)
    return shaped(both.withColumns({"message_id": F.col("row_idx").cast("string"), "source_file": F.lit("conversations"), "utc_offset_s": F.lit(0)}))


def conversation_roles(messages: DataFrame) -> DataFrame:
    """A role mapping for messages_from_conversations: assistants are AGENT, users USER."""
    return messages.where("message_type = 'message'").select("sender").distinct().withColumn("role", F.when(F.col("sender").startswith("assistant"), "AGENT").otherwise("USER"))


#: Texts that rows of messages_with_faults have instead of their own, by row_idx % 20 (Spark and DuckDB read them alike).
FAULT_TEXTS = {
    1: "'my token: abcd1234efgh9999 is set'", 2: "'call +886 912 345 678 now'", 6: "'ask @handle_name or bob77 then'", 8: "'帳號：abc_99 ok'",
    3: "''", 4: "''", 5: "'   '", 7: "concat(text, ' https://example.org/a?b=1 請問')", 9: "concat('✅ ', text)", 11: "concat('  ⚠ ', text, chr(10), 'state: done')",
    13: "concat('Order ', cast(row_idx as varchar(9)), ' is late?')", 15: "'ask ann@example.com or 10.0.0.7'", 17: "'see www.example.org/x? now'", 18: "concat('步驟：', text)", 19: "concat(text, '？')",
}


def messages_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages_from_events with planted faults: repeated ids, a second file and offset, times that go back, blank
    and marked texts, attachments. Which rows have which follows from row_idx alone."""
    rows = messages_from_events(spark, sf_dir)
    normal, i = F.col("message_type") == "message", F.col("row_idx")
    text = F.expr("CASE row_idx % 20 " + " ".join(f"WHEN {k} THEN {v}" for k, v in FAULT_TEXTS.items()) + " ELSE text END")
    item = lambda kind, path: F.struct(F.lit(kind).alias("type"), F.lit(path).alias("path"), *[F.lit(None).cast(t).alias(n) for n, t in (("title", "string"), ("html_class", "string"), ("reference_exists", "boolean"), ("local_exists", "boolean"), ("availability", "string"))])
    one, two = F.array(item("photo", "photos/a.JPG")), F.array(item("photo", "photos/b.jpg"), item("file", "files/c.tar.gz"))
    attachments = F.when(normal & (i % 10 == 3), one).when(normal & (i % 10 == 4), two)
    return rows.withColumns(
        {
            "message_id": F.when(i % 97 == 13, (i - 1).cast("string")).otherwise(F.col("message_id")),
            "source_file": F.when(i % 89 == 2, F.lit("other")).otherwise(F.col("source_file")),
            "ts": F.when(i % 101 == 7, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")),
            "utc_offset_s": F.when(normal & (i % 50 == 3), F.lit(7200)).otherwise(F.col("utc_offset_s")),
            "text": F.when(normal, text).otherwise(F.col("text")),
            "attachments": attachments,
            "attachment_type": F.when(normal & (i % 10 == 3), F.lit("photo")).when(normal & (i % 10 == 4), F.lit("multiple")),
        }
    )
