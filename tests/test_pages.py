"""The strict page parser on pages of our own, and what crosses pages."""

from pyspark.sql import functions as F

from colloquy.sources import io, pages


def page(*rows, tail="</div></div></div></body></html>"):
    return '<html><body><div class="page_wrap"><div class="page_body chat_page"><div class="history">' + "".join(rows) + tail


def row(i, text="hi", name="Ann", joined=False, extra="", minute=0):
    named = f'<div class="from_name"> {name} </div>' if name else ""
    return f'<div class="message default clearfix{" joined" if joined else ""}" id="message{i}"><div class="body"><div class="date" title="01.02.2024 10:{minute:02}:00 UTC+08:00"></div>{named}{extra}<div class="text">{text}</div></div></div>'


def service(i, text):
    return f'<div class="message service" id="message-{i}"><div class="body">{text}</div></div>'


def run(spark, **files):
    df = spark.createDataFrame([(k.replace("_", ".", 1), v) for k, v in files.items()], "source_file string, html string")
    return pages.messages(pages.parsed(df))


def test_joined_inherits_across_pages_and_order_is_by_time(spark):
    out, errors, _ = run(spark, messages2_html=page(row(3, name=None, joined=True, minute=9)), messages_html=page(row(1, "one<br>two &amp; <b>three</b> 🙂 好"), row(2, name=None, joined=True, minute=1)))
    got = out.orderBy("row_idx").collect()
    assert errors.count() == 0 and [(r["row_idx"], r["message_id"], r["sender"], r["sender_inherited"]) for r in got] == [(0, "1", "Ann", False), (1, "2", "Ann", True), (2, "3", "Ann", True)]
    assert got[0]["text"] == "one\ntwo & three 🙂 好" and got[0]["datetime"] == "2024-02-01T10:00:00+08:00" and got[0]["utc_offset_s"] == 28800 and got[0]["ts"].hour == 2


def test_service_and_date_rows_end_inheritance(spark):
    for between in (service(9, "x created topic y"), service(9, "3 March 2024")):
        out, errors, _ = run(spark, messages_html=page(row(1), between, row(2, name=None, joined=True)))
        assert errors.count() == 1 and "2" not in {r["message_id"] for r in out.collect()}
    out, _, _ = run(spark, messages_html=page(service(9, "3 March 2024"), service(8, "x created topic y")))
    assert [(r["message_id"], str(r["date_context"]), r["sender"]) for r in out.collect()] == [("-8", "2024-03-03", None)]


def test_replies_forwards_attachments(spark):
    reply = '<div class="reply_to details">In reply to <a href="messages%283%29.html#go_to_message7">x</a></div>'
    forward = '<div class="forwarded body"><div class="from_name">Bob <span class="date" title="01.01.2024 00:00:00 UTC+08:00"></span></div><div class="text">inner</div></div>'
    media = '<div class="media_wrap clearfix"><a class="media clearfix media_file" href="files/a.pdf"><div class="title">a.pdf</div></a><div class="media clearfix media_photo"><div class="title">Photo</div>Not included, change data exporting settings to download.</div><a class="media media_voice_message" href="v.ogg"></a></div>'
    out, errors, _ = run(spark, messages_html=page(row(1, extra=reply), row(2, extra=forward), row(3, text="", extra=media)))
    got = {r["message_id"]: r for r in out.collect()}
    assert errors.count() == 0 and (got["1"]["reply_to"], got["1"]["reply_to_source_file"]) == ("7", "messages(3).html")
    assert got["2"]["text"] == "hi\ninner" and got["2"]["own_text"] == "hi" and got["2"]["forwarded"][0]["sender"] == "Bob" and got["2"]["forwarded"][0]["datetime"] == "2024-01-01T00:00:00+08:00"
    assert [a["type"] for a in got["3"]["attachments"]] == ["file", "photo", "voice"] and got["3"]["attachment_type"] == "multiple"
    found = pages.with_files(out, spark.createDataFrame([("files/a.pdf",)], "path string")).where("message_id = '3'").first()
    assert [(a["availability"], a["local_exists"]) for a in found["attachments"]] == [("present", True), ("not_exported", False), ("missing", False)]


def test_unknown_structures_are_errors(spark):
    for bad in (row(1, name=None), row(1, extra='<div class="poll"></div>'), row("x"), row(1, extra='<div class="reply_to"><a href="https://a.b/#message1">x</a></div>'), row(1, extra='<div class="media_wrap"><div class="odd"></div></div>')):
        out, errors, _ = run(spark, messages_html=page(bad, row(5)))
        assert errors.count() == 1 and [r["message_id"] for r in out.collect()] == ["5"]
    assert run(spark, messages_html="<html><body><div></body></html>")[1].count() == 1
    out, errors, warnings = run(spark, messages_html=page(row(1), tail=""))
    assert errors.count() == 0 and out.count() == 1 and warnings.count() == 1


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "messages.html").write_text(page(row(1), row(2, minute=2)), encoding="utf-8")
    report = io.preprocess(spark, str(source), str(tmp_path / "out"))
    assert report["errors"] == 0 and io.read_messages(spark, str(tmp_path / "out")).count() == 2
    (source / "messages2.html").write_text(page(row(2, minute=5)), encoding="utf-8")
    report = io.preprocess(spark, str(source), str(tmp_path / "out2"))
    assert report["errors"] == 1 and not (tmp_path / "out2").exists()


def test_csv_with_mark_and_nested_columns(spark, tmp_path):
    df = spark.createDataFrame([("Ann", ["a", "b"]), ("Bo", [])], "sender string, x array<string>")
    io.write_csv(df, str(tmp_path / "a.csv"))
    raw = (tmp_path / "a.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b'[""a"",""b""]' in raw
    (tmp_path / "m.csv").write_text("﻿sender,role,confidence,notes\nAnn,AGENT,,\n", encoding="utf-8")
    assert io.read_mapping(spark, str(tmp_path / "m.csv")).collect()[0]["sender"] == "Ann"


def test_lenient_reader_and_reconciliation(spark):
    html = page(row(1, "x 🙂\n"), row(2, name=None, joined=True))
    df = spark.createDataFrame([("messages.html", html)], "source_file string, html string")
    both = pages.reconciled(pages.lenient(df), pages.messages(pages.parsed(df))[0]).collect()
    assert len(both) == 2 and all(r["text_match"] and r["reply_match"] and r["attachment_match"] for r in both)
    assert pages.lenient(spark.createDataFrame([("p", "<div class=message id=message3><p>a")], "source_file string, html string")).select(F.col("message_id")).collect() == [("3",)]
