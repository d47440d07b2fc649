from colloquy.sources.messages import messages_from_events
from colloquy.streaming.activity import sender_sessions, tumbling_activity


def test_streams_equal_batches(spark, sf, tmp_path):
    batch = messages_from_events(spark, sf).select("message_type", "ts", "sender")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    for name, f in (("tumbling", tumbling_activity), ("sessions", sender_sessions)):
        stream = f(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append" if name == "sessions" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(300) and not q.exception()
        expected = {tuple(r) for r in f(batch).collect()}
        got = {tuple(r) for r in spark.table(name).collect()}
        assert got == expected if name == "tumbling" else got <= expected and len(got) > 0
