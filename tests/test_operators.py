"""Rules that no table of the driver exercises, on small literal messages, against values worked out by hand or by a plain model."""

import itertools
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import audit, checks, graph, profile, reconstruct, roles, sampling, segmentation, singles
from colloquy.operators.ordered import with_previous, with_running_sum
from colloquy.sources.messages import MESSAGE, shaped

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def chat(spark, rows):
    """rows: (id, sender or None for a topic row, seconds, reply_to)."""
    out = []
    for i, (mid, sender, at, reply) in enumerate(rows):
        out.append({"row_idx": i, "message_id": mid, "source_file": "f", "message_type": "message" if sender else "service", "ts": BASE + timedelta(seconds=at) if sender else None, "utc_offset_s": 0 if sender else None, "sender": sender, "text": f"text {mid}" if sender else f"x created topic {mid}", "reply_to": reply})
    return spark.createDataFrame([tuple(r.get(f.name) for f in MESSAGE.fields) for r in out], MESSAGE)


def test_gap_bins_at_their_bounds(spark):
    steps = [59, 60, 299, 300, 599, 600, 1799, 1800, 3599, 3600, 21600, 21601]
    at = [0, *itertools.accumulate(steps)]
    got = {r["bin"]: r["n"] for r in profile.gap_histogram(chat(spark, [(f"m{i}", "a", t, None) for i, t in enumerate(at)])).collect()}
    assert got == {"<1 minute": 1, "1-5 minutes": 2, "5-10 minutes": 2, "10-30 minutes": 2, "30-60 minutes": 2, "1-6 hours": 2, ">6 hours": 1}


def test_one_message_and_none(spark):
    one, none = chat(spark, [("a", "s", 0, None)]), chat(spark, [])
    assert sum(r["n"] for r in profile.gap_histogram(one).collect()) == 0
    assert profile.gap_describe(none).first()["count"] == 0 and profile.daily_counts(none).count() == 0
    assert graph.ancestors(none).count() == 0


def test_ancestors_of_each_kind(spark):
    rows = [("t", None, 0, None), ("a", "x", 1, "t"), ("b", "y", 2, "a"), ("c", "x", 3, "b"), ("d", "y", 4, "gone"), ("e", "x", 5, "d"), ("f", "y", 6, None)]
    got = {r["message_id"]: (r["depth"], r["termination"], r["topic"], r["component"], r["component_size"], r["context"]) for r in graph.ancestors(chat(spark, rows)).collect()}
    assert got == {
        "a": (1, "service", "t", "a", 3, "topic"), "b": (2, "service", "t", "a", 3, "topic"), "c": (3, "service", "t", "a", 3, "topic"),
        "d": (0, "missing_target", None, "d", 2, "missing_root"), "e": (1, "missing_target", None, "d", 2, "missing_root"), "f": (0, "normal_no_reply", None, "f", 1, "unknown_root"),
    }


def test_cycle_is_marked_or_raised(spark):
    rows = chat(spark, [("a", "x", 0, "b"), ("b", "y", 1, "a"), ("c", "x", 2, None)])
    assert {r["message_id"]: r["termination"] for r in graph.ancestors(rows, on_cycle="mark").collect()} == {"a": "cycle", "b": "cycle", "c": "normal_no_reply"}
    with pytest.raises(ValueError):
        graph.ancestors(rows)


def plain_merge(proposals, minutes, size):
    up, anchored, log = {}, {}, []

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for gap, rb, ra, ca, cb in sorted(proposals):
        if gap > minutes * 60:
            continue
        a, b = find(ca), find(cb)
        if a == b:
            continue
        if anchored.get(a, size[ca if a == ca else a] > 1) and anchored.get(b, size[cb if b == cb else b] > 1):
            log.append("blocked")
            continue
        anchored[a] = anchored.get(a, size[a] > 1) or anchored.get(b, size[b] > 1)
        up[b] = a
        log.append("accepted")
    return log.count("accepted"), log.count("blocked")


def test_merge_in_one_pass_equals_one_for_each_threshold(spark):
    r = random.Random(5)
    rows, t = [("t", None, 0, None)], 0
    for i in range(150):
        t += r.choice([30, 400, 700, 2000, 4000])
        back = [m for m in rows[max(1, i - 4) :] if m[1]]
        rows.append((f"m{i}", r.choice("ab"), t, r.choice(back)[0] if back and r.random() < 0.4 else "t"))
    msgs = chat(spark, rows)
    found = graph.persisted(graph.ancestors(msgs))
    offers = segmentation.weak_proposals(msgs, found).collect()
    size = {r["component"]: r["component_size"] for r in found.collect()}
    counts = {(r["threshold"], r["kind"]): r["count"] for r in segmentation.merged(segmentation.weak_proposals(msgs, found)).groupBy("threshold", "kind").count().collect()}
    for minutes in segmentation.THRESHOLDS:
        accepted, blocked = plain_merge([(o["gap"], o["row_b"], o["row_a"], o["component_a"], o["component_b"]) for o in offers], minutes, size)
        assert (counts.get((minutes, "accepted"), 0), counts.get((minutes, "blocked"), 0)) == (accepted, blocked)
    members = segmentation.membership(msgs, found, segmentation.merged(segmentation.weak_proposals(msgs, found)))
    assert members.groupBy("threshold").count().select("count").distinct().collect()[0][0] == 150
    assert checks.broken_replies(graph.direct_edges(graph.parents(msgs)), members.where("threshold = 10")).isEmpty()


def test_reply_after_five_hours_stays_together(spark):
    msgs = chat(spark, [("a", "x", 0, None), ("b", "y", 18000, "a")])
    found = graph.ancestors(msgs)
    members = segmentation.membership(msgs, found, segmentation.merged(segmentation.weak_proposals(msgs, found)))
    assert {(r["threshold"], r["n"]) for r in members.groupBy("threshold").agg(F.countDistinct("conversation_id").alias("n")).collect()} == {(t, 1) for t in segmentation.THRESHOLDS}


def test_singles_by_class(spark):
    rows = [("t", None, 0, None), ("u", None, 0, None), ("a", "x", 0, "t"), ("b", "y", 3600, "t"), ("c", "x", 7300, "t"), ("d", "y", 20000, "t"), ("e", "x", 30000, "u"), ("f", "x", 40000, "lost")]
    msgs = chat(spark, rows)
    found = graph.persisted(graph.ancestors(msgs))
    members = segmentation.membership(msgs, found, segmentation.merged(segmentation.weak_proposals(msgs, found)))
    got = {r["message_id"]: r["structural_classification"] for r in singles.singles(msgs, found, members).collect()}
    assert got == {"a": "POSSIBLE_NEXT", "b": "POSSIBLE_PREVIOUS", "c": "STRUCTURALLY_ISOLATED", "d": "STRUCTURALLY_ISOLATED", "e": "STRUCTURALLY_ISOLATED", "f": "UNKNOWN"}
    bins = {(r["side"], r["bin"]): r["n"] for r in singles.gap_bins(singles.singles(msgs, found, members)).collect()}
    assert bins[("previous", "1-2 hr")] == 2 and bins[("next", "no_neighbor")] == 3 and len(bins) == 16


def test_max_cut_and_communities():
    pairs = [("a", "b", 5.0), ("b", "c", 5.0), ("a", "c", 5.0), ("d", "e", 7.0), ("c", "d", 1.0), ("a", "a", 99.0)]
    got = graph.graph_figures(pairs)
    assert got["edges"] == 5 and got["total_weight"] == 23 and {frozenset(g) for g in got["communities"]} == {frozenset("abc"), frozenset("de")}
    w = np.array([[0, 5, 5, 0, 0], [5, 0, 5, 0, 0], [5, 5, 0, 1, 0], [0, 0, 1, 0, 7], [0, 0, 0, 7, 0]], float)
    best = max(sum(w[i][j] for i in range(5) for j in range(i) if s[i] != s[j]) for s in itertools.product([0, 1], repeat=5))
    assert graph.max_cut(w)[0] == best == got["max_cut_fraction"] * 23
    assert graph.graph_figures([(f"s{i}", f"s{i + 1}", 1.0) for i in range(20)])["max_cut_status"] == "not_computed_node_limit"


def roled(spark, rows, mapping):
    return roles.with_roles(chat(spark, rows), spark.createDataFrame(list(mapping.items()), "sender string, role string"))


ROLES = {"ag": "AGENT", "u1": "USER", "u2": "USER", "bt": "BOT"}


def rebuilt(spark, rows, minutes=10):
    msgs = roled(spark, rows, ROLES)
    found = graph.persisted(graph.ancestors(msgs))
    members = segmentation.membership(msgs, found, segmentation.merged(segmentation.weak_proposals(msgs, found), (60,)), (60,))
    placed = graph.persisted(reconstruct.placed(msgs, members))
    offers = graph.persisted(reconstruct.proposals(placed, minutes))
    decisions = graph.persisted(reconstruct.decided(offers, placed))
    return offers, decisions, reconstruct.rebuilt(placed, decisions, minutes)


def test_role_aware_merge_guards(spark):
    rows = [("t", None, 0, None), ("a", "u1", 0, "t"), ("b", "ag", 60, "t"), ("c", "u1", 120, "t"), ("d", "u2", 180, "t"), ("e", "bt", 240, "t")]
    offers, decisions, again = rebuilt(spark, rows)
    by = {tuple(r["boundary_message_ids"]): r for r in reconstruct.audit(offers, decisions).collect()}
    assert by[("a", "b")]["merge_score"] == 90 and by[("a", "b")]["decision"] == "MERGE" and "agent_bridge" in by[("a", "b")]["merge_reason"]
    assert by[("c", "d")]["rejection_reason"] == "unknown_only_or_no_role_participant_evidence" and by[("d", "e")]["rejection_reason"] == "bot_boundary_no_evidence"
    where = {r["message_id"]: r["conversation_id"] for r in again.collect()}
    assert where["a"] == where["b"] == where["c"] == "agent_10m_a" and where["d"] == "agent_10m_d"
    risk = {r["conversation_id"]: r["risk"] for r in reconstruct.risks(again).collect()}
    assert risk["agent_10m_a"] == "LOW"


def test_shared_agent_does_not_join_two_users(spark):
    rows = [("t", None, 0, None), ("a", "u1", 0, "t"), ("b", "ag", 60, "t"), ("c", "u2", 120, "t")]
    offers, decisions, again = rebuilt(spark, rows)
    by = {tuple(r["boundary_message_ids"]): r["rejection_reason"] for r in reconstruct.audit(offers, decisions).collect()}
    assert sorted(by.values(), key=str) == [None, "different_non_agent_participants_component_guard"] or list(by.values()).count("different_non_agent_participants_component_guard") == 1


def test_roles_must_be_complete(spark):
    with pytest.raises(ValueError):
        roled(spark, [("a", "u9", 0, None)], ROLES)
    with pytest.raises(ValueError):
        roled(spark, [("a", "u1", 0, None)], {"u1": ""})


def test_agent_window_and_followups(spark):
    rows = [("t", None, 0, None)] + [(f"b{i}", "u1", i, "t") for i in range(12)] + [("g", "ag", 20, "t"), ("x", "u2", 20, "g"), ("y", "ag", 319, "t"), ("z", "u1", 321, "t"), ("far", "u1", 20 + 3601, "t")]
    msgs = roled(spark, rows, ROLES)
    found = graph.persisted(graph.ancestors(msgs))
    pool = audit.pooled(msgs, found)
    w = {r["message_id"]: r for r in audit.windows(pool).collect()}
    assert [x["message_id"] for x in w["g"]["before"]] == [f"b{i}" for i in range(2, 12)] and [x["message_id"] for x in w["g"]["after"]] == ["x", "y", "z"]
    f = {(r["message_id"], r["minutes"]): r for r in audit.followups(pool, graph.parents(msgs)).collect()}
    assert f["g", 5]["response"] and f["g", 5]["direct_reply"] and f["y", 5]["response"] and not f["y", 5]["direct_reply"] and f["g", 60]["response_ids"] == ["x", "z"]
    labels = audit.episodes(pool)
    assert {r["episode"] for r in labels.collect()} == {13} and audit.overlaps(audit.episode_members(pool, labels).join(pool.select("message_id", "topic"), "message_id")).isEmpty()
    table = audit.episode_table(pool, labels).first()
    assert table["agent_message_count"] == 2 and table["agent_anchor_ids"] == ["g", "y"]
    made = audit.features(msgs, found).collect()
    assert {r["message_id"]: r["window_after_count"] for r in made} == {"g": 3, "y": 2}


def test_patterns(spark):
    rows = ["看https://a.b/c?x=1 好", "mail naïve.x+1@ex-ample.co.uk now", "ip 10.0.0.1, not 1.2.3.4.5", "call +1 (017) 555-7713 or 2024-01-02", "password： hunter2x", "電話12345678是字", "帳號：abc_1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    got = [r.asDict() for r in df.select("i", *[c.alias(k) for k, c in tx.pii_flags(F.col("text")).items()], tx.redact(F.col("text"), "profile").alias("p"), tx.redact(F.col("text"), "roles").alias("r")).orderBy("i").collect()]
    assert got[0]["url"] and got[0]["p"] == "看[URL] 好" and got[1]["email"] and got[1]["p"] == "mail [EMAIL] now" and got[2]["ip_candidate"]
    assert got[3]["phone_candidate"] and got[3]["p"] == "call [PHONE_CANDIDATE] or 2024-01-02" and got[4]["credential_candidate"] and got[4]["p"] == "password： [REDACTED]"
    assert not got[5]["phone_candidate"] and got[6]["r"] == "帳號：[ACCOUNT]"
    assert spark.createDataFrame([("什麼時候 https://x.y/?a",), ("https://x.y/?a",)], "t string").select(F.size(tx.question_hits(F.col("t"))).alias("n")).collect() == [(1,), (0,)]


def test_neighbours_across_runs(spark, monkeypatch):
    from colloquy.operators import ordered

    monkeypatch.setattr(ordered, "SPAN", 7)
    df = spark.range(100).where("id % 9 <> 4").select(F.col("id").alias("row_idx"), (F.col("id") * 3).alias("v"))
    ids = [i for i in range(100) if i % 9 != 4]
    got = {r["row_idx"]: r["p"] for r in with_previous(df, {"p": "v"}).collect()}
    assert got == {b: (a * 3 if a is not None else None) for a, b in zip([None, *ids], ids)}
    sums = {r["row_idx"]: r["s"] for r in with_running_sum(df, F.col("v"), "s").collect()}
    assert sums == dict(zip(ids, itertools.accumulate(i * 3 for i in ids)))


def test_stratified_sample(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10).alias("m"))
    strata = {"rare": F.col("m") == 3, "common": F.col("m") < 8}
    a, b = sampling.stratified(df, "k", strata, 7, 50, scarce_first=True), sampling.stratified(df.repartition(7), "k", strata, 7, 50, scarce_first=True)
    n = {r["stratum"]: r["count"] for r in a.groupBy("stratum").count().collect()}
    assert n == {"rare": 7, "common": 7, "rest": 36} and sorted(a.collect()) == sorted(b.collect()) and sampling.uniform(df, "k", 10).count() == 10


def test_extra_and_missing_columns(spark):
    assert shaped(spark.createDataFrame([("1", 2)], "message_id string, other int")).columns == [f.name for f in MESSAGE.fields]
