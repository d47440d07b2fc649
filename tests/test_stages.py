"""The stages as commands, on small exports and tables of our own."""

import csv
import json
from pathlib import Path

import pytest

from colloquy import stages
from colloquy.sources import io
from tests.test_pages import page, row, service


def lines(folder):
    return [json.loads(x) for f in sorted(Path(folder).glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]


def table(path, rows):
    keys = {"source_file": "messages.html", "message_type": "message", "text": "synthetic", "reply_to": None, "attachments": [], "attachment_type": None, "forwarded": []}
    path.write_text("\n".join(json.dumps(keys | r) for r in rows), encoding="utf-8")
    return str(path)


def test_several_pages_in_the_order_of_time(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "messages.jsonl"
    source.mkdir()
    (source / "messages.html").write_text(page(row(1, "first")), encoding="utf-8")
    (source / "messages(1).html").write_text(page(row(2, "second", minute=1)), encoding="utf-8")
    assert stages.main(["preprocess", "--input-dir", str(source), "--output", str(out)], spark) == 0
    assert [r["message_id"] for r in sorted(lines(out), key=lambda r: r["row_idx"])] == ["1", "2"]
    assert json.loads((tmp_path / "messages.jsonl_report.json").read_text())["errors"] == 0


def test_a_repeated_id_fails_and_writes_no_table(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "messages.jsonl"
    source.mkdir()
    for name in ("messages.html", "messages2.html"):
        (source / name).write_text(page(row(1)), encoding="utf-8")
    assert stages.main(["preprocess", "--input-dir", str(source), "--output", str(out)], spark) == 1
    assert not out.exists() and (tmp_path / "messages.jsonl_report.json").exists()
    with pytest.raises(ValueError):
        io.outside(str(source / "x"), str(source))


def test_matrix_of_two_senders_and_a_mapping_that_stays(spark, tmp_path):
    path = table(tmp_path / "in.jsonl", [{"message_id": str(i), "sender": s, "datetime": f"2025-06-19T19:02:0{i}+08:00"} for i, s in ((1, "Ann"), (2, "Bo"))])
    out = tmp_path / "roles"
    assert stages.main(["roles", "--input", path, "--output-dir", str(out), "--evidence-sender", "Ann"], spark) == 0
    with (out / "sender_reply_matrix.csv").open(encoding="utf-8-sig") as f:
        assert len(list(csv.DictReader(f))) == 2
    mapping = out / "sender_role_mapping.csv"
    mapping.write_text("sender,role,confidence,notes\nAnn,AGENT,high,\nBo,USER,,\n", encoding="utf-8")
    stages.roles(spark, path, str(out))
    assert "AGENT" in mapping.read_text(encoding="utf-8")
    mapping.write_text("sender,role,confidence,notes\nAnn,KING,,\nBo,USER,,\n", encoding="utf-8")
    assert stages.main(["roles", "--input", path, "--output-dir", str(out)], spark) == 1


def test_a_reply_after_five_hours_stays_together(spark, tmp_path):
    rows = [{"message_id": str(i), "sender": s, "datetime": f"2025-06-19T{h}:00:00+08:00", "reply_to": "1" if i == 2 else None, "reply_to_source_file": "messages.html" if i == 2 else None} for i, s, h in ((1, "Ann", "10"), (2, "Bo", "15"))]
    path = table(tmp_path / "in.jsonl", rows)
    assert stages.main(["segment", "--input", path, "--output-dir", str(tmp_path / "s")], spark) == 0
    for t in (10, 30, 60, 120):
        found = lines(tmp_path / "s" / f"segmentation_{t}m.jsonl")
        assert len(found) == 1 and found[0]["message_count"] == 2 and len(found[0]["messages"]) == 2


def test_all_stages_in_turn(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    reply = '<div class="reply_to details"><a href="#go_to_message-7">x</a></div>'
    rows = [service(7, "desk created topic help")]
    rows += [row(i, f"text {i} 請問" if i % 3 else f"text {i}", name="Ann" if i % 2 else "Bo", minute=i, extra=reply if i < 5 else "") for i in range(1, 9)]
    (source / "messages.html").write_text(page(*rows), encoding="utf-8")
    mapping = tmp_path / "mapping.csv"
    mapping.write_text("sender,role,confidence,notes\nAnn,AGENT,,\nBo,USER,,\n", encoding="utf-8")
    args = ["all", "--input-dir", str(source), "--output-dir", str(out), "--mapping", str(mapping)]
    assert stages.main(args, spark) == 0
    runs = json.loads((out / "run_manifest.json").read_text())
    assert [r["stage"] for r in runs] == ["preprocess", "profile", "segment", "singletons", "roles", "validate_raw", "reconstruct", "audit"] and not any(r["exit_code"] for r in runs)
    checked = json.loads((out / "validation" / "raw_verification.json").read_text())
    assert checked["rows_that_pass"] == checked["parsed_messages"] == 9 and all(t["all_messages_preserved"] for t in checked["thresholds"])
    assert sum(len(c["messages"]) for c in lines(out / "segmentation" / "segmentation_60m.jsonl")) == 9
    episodes = lines(out / "agent_audit" / "agent_episodes.jsonl")
    assert episodes and all(e["messages"] and e["context_provenance"] for e in episodes)
    # what people have filled in stays
    review = out / "agent_audit" / "agent_episode_review.md"
    review.write_text(review.read_text(encoding="utf-8") + "\n- [x] seen\n", encoding="utf-8")
    with pytest.raises(ValueError, match="ticks"):
        stages.audit(spark, str(out / "messages.jsonl"), str(mapping), str(out / "agent_audit"))
    # a page with an unknown part stops the run at its first stage
    (source / "messages2.html").write_text(page(row(99, extra='<div class="poll"></div>', minute=30)), encoding="utf-8")
    assert stages.main(["all", "--input-dir", str(source), "--output-dir", str(tmp_path / "again")], spark) == 1
    assert [r["exit_code"] for r in json.loads((tmp_path / "again" / "run_manifest.json").read_text())] == [1]
