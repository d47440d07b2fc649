"""The stages as functions and commands: each reads what the one before wrote, and writes tables and reports.

    python -m colloquy.stages preprocess --input-dir EXPORT --output OUT/messages
    python -m colloquy.stages all --input-dir EXPORT --output-dir OUT --mapping MAPPING.csv

Tables of any size (messages, conversations, episodes) are JSON Lines folders that executors write; reports are
files. A stage whose input breaks a rule raises ValueError and writes nothing; one whose input changes
meanwhile raises RuntimeError. The commands then end with 1.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import blank, redact
from colloquy.operators import audit as audits
from colloquy.operators import checks, graph, reconstruct as rebuild, roles as people, sampling, segmentation, singles
from colloquy.operators import profile as figures
from colloquy.operators.graph import persisted
from colloquy.sources import io, pages
from colloquy.sources.messages import read_messages, replaced

SEED = sampling.SEED


def _messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages that pass the checks every stage relies on."""
    rows = persisted(read_messages(spark, path))
    if not checks.duplicate_ids(rows).isEmpty():
        raise ValueError("a message id stands twice")
    if not checks.chronology_violations(rows).isEmpty():
        raise ValueError("messages are not in the order of time")
    return rows


def _folder(path: str) -> Path:
    Path(path).mkdir(parents=True, exist_ok=True)
    return Path(path)


def _row(df: DataFrame) -> dict:
    found = df.first()
    return found.asDict(recursive=True) if found else {}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def nested(members: DataFrame, messages: DataFrame, talks: DataFrame, keys: list[str]) -> DataFrame:
    """talks with messages: the whole rows of each conversation, in order."""
    rows = members.select(*keys, "message_id").join(messages, "message_id")
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_idx", *[c for c in messages.columns if c != "row_idx"]))).alias("messages"))
    return talks.join(held, keys)


def preprocess(spark: SparkSession, input_dir: str, output: str) -> dict:
    """Pages to a message table; a report beside it always, the table only without errors."""
    report = io.preprocess(spark, input_dir, output)
    io.write_json(report, output.rstrip("/") + "_report.json")
    return report


def profile(spark: SparkSession, input: str, output_dir: str, seed: int = SEED) -> dict:
    """Figures about time, senders, replies and texts: profile.json, profile.md, senders.csv, sample.csv."""
    with io.only_read(spark, input):
        rows = _messages(spark, input)
        if checks.offsets(rows).count() > 1:
            raise ValueError("messages have several UTC offsets")
        found = persisted(graph.ancestors(rows, on_cycle="mark"))
        normal = rows.where("message_type = 'message'")
        one = {
            "summary": checks.summary(rows), "gaps": figures.gap_describe(rows), "activity": figures.tumbling_activity(rows, found), "switches": figures.sender_switches(rows),
            "aba": figures.aba_triples(rows), "root_switches": figures.near_root_switches(rows, found), "texts": figures.text_length_stats(normal), "duplicates": figures.duplicate_texts(normal), "personal_data": figures.pii_counts(normal),
        }
        tables = {
            "Gaps": figures.gap_histogram(rows), "Hours": figures.hourly_counts(rows).orderBy("hour"), "Days": figures.daily_counts(rows).orderBy("day"), "Service rows by day": figures.service_counts(rows),
            "Senders": figures.sender_stats(rows).orderBy(F.desc("message_count"), "sender"), "Reply targets": figures.reply_target_types(rows), "Most replied to": figures.top_reply_targets(rows),
            "Depth of reply chains": found.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth"), "Ends of reply chains": found.groupBy("termination").agg(F.count("*").alias("n")),
            "Runs of one sender": figures.run_length_distribution(rows).orderBy("length"), "Frequent texts": figures.top_texts(normal, "row_idx"),
        }
        out = _folder(output_dir)
        report = {k: _row(v) for k, v in one.items()} | {k: _rows(v) for k, v in tables.items() if k != "Frequent texts"}
        anchors = sampling.uniform(normal.where(~blank(F.col("text"))), "message_id", 100, seed).select("row_idx")
        sample = sampling.around(rows.select("row_idx", "message_id", "sender", "datetime", "text"), anchors).withColumn("text", redact(F.col("text"), "profile"))
        io.write_csv(sample.orderBy("anchor", "row_idx"), str(out / "sample.csv"))
        io.write_csv(figures.sender_stats(rows).join(figures.sender_aliases(rows), "sender").orderBy(F.desc("message_count"), "sender"), str(out / "senders.csv"))
        io.write_csv(figures.reply_root_groups(rows, found), str(out / "reply_roots.csv"))
        io.write_markdown("Profile", tables, str(out / "profile.md"))
        io.write_json(report, str(out / "profile.json"))
    return report


def segment(spark: SparkSession, input: str, output_dir: str, seed: int = SEED) -> list[dict]:
    """Conversations at four thresholds: segmentation_<n>m (JSON Lines), comparison and review samples."""
    with io.only_read(spark, input):
        rows = _messages(spark, input)
        found = persisted(graph.ancestors(rows))
        linked = persisted(graph.parents(rows))
        edges = persisted(graph.direct_edges(linked))
        decided = persisted(segmentation.merged(segmentation.weak_proposals(rows, found)))
        members = persisted(segmentation.membership(rows, found, decided))
        talks = persisted(segmentation.conversations(rows, members, edges))
        compared = segmentation.comparison(talks, decided, members, linked, found).orderBy("threshold")
        stable = segmentation.stability(members).orderBy("threshold")
        out, reviews = _folder(output_dir), {}
        every = segmentation.with_system_events(rows, members)
        for t in segmentation.THRESHOLDS:
            own = every.where(F.col("threshold") == t)
            if not checks.broken_replies(edges, own).isEmpty() or not checks.incomplete_partition(rows, own).isEmpty():
                raise ValueError("conversations split a reply or lose a message")
            services = own.where("candidate_type = 'system_event'").select("threshold", "conversation_id", F.lit(1).cast("long").alias("message_count"), F.lit(0).cast("long").alias("sender_count"))
            both = talks.where(F.col("threshold") == t).withColumn("candidate_type", F.lit("chat")).unionByName(services.withColumn("candidate_type", F.lit("system_event")), allowMissingColumns=True)
            replaced(nested(own, rows, both, ["threshold", "conversation_id"]), str(out / f"segmentation_{t}m.jsonl"))
            picked = segmentation.review_sample(talks, t, seed)
            reviews[f"Review at {t} minutes"] = picked.join(talks.where(F.col("threshold") == t), "conversation_id").orderBy("first_row")
            texts = picked.join(own, "conversation_id").join(rows.select("message_id", "datetime", "sender", redact(F.col("text"), "segmentation").alias("text"), "reply_to", "attachment_type"), "message_id")
            io.write_csv(texts.select("conversation_id", "stratum", "row_idx", "message_id", "datetime", "sender", "text", "reply_to", "attachment_type").orderBy("conversation_id", "row_idx"), str(out / f"review_{t}m.csv"))
        io.write_csv(compared, str(out / "segmentation_comparison.csv"))
        counts = segmentation.sender_count_distribution(talks).orderBy("threshold", "sender_count")
        io.write_markdown("Segmentation", {"Comparison": compared, "Senders of a conversation": counts, "Stability": stable, **reviews}, str(out / "segmentation_report.md"))
    return _rows(compared)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(threshold, conversation_id, message_id, row_idx, topic, component) of the chat rows of a segmentation_<n>m folder."""
    schema = "threshold int, conversation_id string, candidate_type string, topic string, messages array<struct<row_idx: bigint, message_id: string>>"
    flat = spark.read.schema(schema).json(path).where("candidate_type = 'chat'").select("threshold", "conversation_id", "topic", F.explode("messages").alias("m"))
    return flat.select("threshold", "conversation_id", "m.message_id", "m.row_idx", "topic")


def singletons(spark: SparkSession, segmentation_path: str, messages: str, output_dir: str, seed: int = SEED) -> dict:
    """Conversations of one message: their neighbours, classes and figures."""
    with io.only_read(spark, segmentation_path, messages):
        rows = _messages(spark, messages)
        found = persisted(graph.ancestors(rows))
        members = persisted(read_conversations(spark, segmentation_path))
        threshold = (members.agg(F.max("threshold").alias("t")).first()["t"]) or 60
        made = persisted(singles.singles(rows, found, members, threshold))
        tables = {
            "Classes": singles.class_counts(made), "Gaps": singles.gap_bins(made), "Neighbours within": singles.proximity(made), "Same sender": singles.continuity(made),
            "No neighbour": singles.no_neighbour(made), "Late replies of singles": singles.long_reply_stats(made), "Overview": singles.overview(made),
        }
        out = _folder(output_dir)
        texts = rows.select("message_id", redact(F.col("text"), "singles").alias("text"))
        io.write_csv(made.join(texts, "message_id").orderBy("message_id"), str(out / "single_message_analysis.csv"))
        io.write_csv(singles.long_distance(rows, found, members).orderBy("message_id"), str(out / "long_distance_replies.csv"))
        picked = persisted(singles.review_sample(made, seed))
        # five rows of the conversations before and after each picked single, around its neighbour
        sides = picked.join(made.select("message_id", "previous_id", "next_id"), "message_id").select(F.col("message_id").alias("single"), F.explode(F.array("previous_id", "next_id")).alias("centre")).where("centre is not null")
        around = sides.join(members.select(F.col("message_id").alias("centre"), "conversation_id"), "centre").join(members.select("conversation_id", "message_id", "row_idx"), "conversation_id")
        shown = sampling.excerpt(around.withColumn("conversation_id", F.concat_ws("/", "single", "centre")), F.col("message_id") == F.col("centre"))
        io.write_csv(shown.select("single", "centre", "message_id", "row_idx").join(texts, "message_id").orderBy("single", "centre", "row_idx"), str(out / "review_context.csv"))
        io.write_csv(picked.join(made, "message_id").join(texts, "message_id").orderBy("message_id"), str(out / "review_singles.csv"))
        report = {k: _rows(v) for k, v in tables.items()}
        io.write_markdown("Conversations of one message", tables, str(out / "single_message_report.md"))
        io.write_json(report, str(out / "single_message_statistics.json"))
    return report


def roles(spark: SparkSession, input: str, output_dir: str, evidence_sender: str | None = None, seed: int = SEED) -> dict:
    """Behaviour of senders, and the mapping that people fill in: kept if it is there and fits, else written blank."""
    with io.only_read(spark, input):
        rows = _messages(spark, input)
        if rows.where("message_type = 'message'").isEmpty():
            raise ValueError("there are no messages")
        found = persisted(graph.ancestors(rows))
        out = _folder(output_dir)
        mapping = out / "sender_role_mapping.csv"
        if mapping.exists():
            people.kept_mapping(rows, io.read_mapping(spark, str(mapping)))
        else:
            io.write_csv(people.mapping_template(rows).orderBy("sender"), str(mapping))
        names = [r["sender"] for r in rows.where("message_type = 'message'").select("sender").distinct().orderBy("sender").toLocalIterator()]
        profiles, reply, near = people.sender_profiles(rows, found), persisted(people.reply_matrix(rows)), persisted(people.adjacency_matrix(rows, found))
        io.write_csv(profiles.orderBy("sender"), str(out / "sender_behavior.csv"))
        io.write_csv(people.dense_matrix(reply, names).orderBy("sender"), str(out / "sender_reply_matrix.csv"))
        io.write_csv(people.dense_matrix(near, names).orderBy("sender"), str(out / "sender_adjacency_matrix.csv"))
        report = {"reply_graph": _row(graph.sender_graph(reply)), "adjacency_graph": _row(graph.sender_graph(near))}
        if evidence_sender is not None:
            report["evidence"] = _row(people.evidence(rows, evidence_sender)) | {
                "interarrival": _row(people.interarrival(rows, evidence_sender)), "hours": _rows(people.hours(rows, evidence_sender).orderBy("hour")),
                **{f"top_{k}": _rows(people.top_values(rows, evidence_sender, k, n)) for k, n in (("text", 8), ("template", 8), ("time", 5))},
            }
        picked = people.review_sample(rows, found, seed).join(rows.select("message_id", "row_idx", "datetime", redact(F.col("text"), "roles").alias("text")), "message_id")
        io.write_csv(picked.orderBy("sender", "row_idx"), str(out / "role_review.csv"))
        io.write_markdown("Senders", {"Replies": reply, "Neighbours in a topic": near, "Texts to review": picked.orderBy("sender", "row_idx")}, str(out / "sender_role_review.md"))
        io.write_json(report, str(out / "sender_graph.json"))
    return report


def _roled(spark: SparkSession, messages: str, mapping: str) -> DataFrame:
    return people.with_roles(_messages(spark, messages), io.read_mapping(spark, mapping).select("sender", "role"))


def reconstruct(spark: SparkSession, baseline: str, messages: str, mapping: str, output_dir: str, seed: int = SEED) -> list[dict]:
    """Conversations joined by role at three windows: agent_aware_<n>m, merge_audit_<n>m, comparison, what became of singles."""
    with io.only_read(spark, baseline, messages, mapping):
        rows = persisted(_roled(spark, messages, mapping))
        found = persisted(graph.ancestors(rows))
        members = read_conversations(spark, baseline).join(found.select("message_id", "component"), "message_id")
        at = persisted(rebuild.placed(rows, members))
        plain = rows.where("message_type = 'message'")
        if at.count() != plain.count():
            raise ValueError("the baseline does not hold every message once")
        edges, services = persisted(graph.direct_edges(graph.parents(rows))), rows.where("message_type = 'service'").count()
        base, near = at.withColumn("source_id", F.col("conversation_id")), persisted(segmentation.topic_neighbours(rows, found).select("message_id", "gap_previous", "gap_next"))
        out, compared, traces, summary = _folder(output_dir), rebuild.metrics(rebuild.risks(base), "Baseline", edges, base, services), None, []
        for t in rebuild.WINDOWS:
            offers = persisted(rebuild.proposals(at, t))
            decisions = persisted(rebuild.decided(offers, at))
            again, checked = persisted(rebuild.rebuilt(at, decisions, t)), persisted(rebuild.audit(offers, decisions))
            if not checks.broken_replies(edges, again).isEmpty():
                raise ValueError("joining split a reply")
            talks = rebuild.risks(again)
            full = persisted(rebuild.conversations(again, talks, checked, edges))
            trace = persisted(rebuild.singleton_trace(again, talks, checked, near).withColumn("threshold_minutes", F.lit(t)))
            compared = compared.unionByName(rebuild.metrics(talks, f"{t}m", edges, again, services))
            traces = trace if traces is None else traces.unionByName(trace)
            replaced(nested(again, rows, full, ["conversation_id"]), str(out / f"agent_aware_{t}m.jsonl"))
            io.write_csv(checked.orderBy("row_b"), str(out / f"merge_audit_{t}m.csv"))
            io.write_csv(rebuild.review_sample(full, trace, t, seed).join(full, "conversation_id").orderBy("first_row"), str(out / f"review_agent_{t}m.csv"))
            summary.append({"threshold": t, "reasons": _rows(rebuild.reasons(checked)), "destinations": _rows(rebuild.destinations(trace).orderBy("new_message_count")), "singles_merged": trace.where("was_merged").count(), "singles_left": trace.where("not was_merged").count()})
        io.write_csv(compared, str(out / "reconstruction_comparison.csv"))
        io.write_csv(traces, str(out / "singleton_reconstruction.csv"))
        io.write_markdown("Role-aware conversations", {"Roles": people.role_counts(rows), "Comparison": compared}, str(out / "reconstruction_report.md"))
        io.write_json(summary, str(out / "reconstruction_summary.json"))
    return _rows(compared)


def audit(spark: SparkSession, messages: str, mapping: str, output_dir: str) -> list[dict]:
    """Agent messages, their episodes, and a table for people to annotate; what people have filled in is never overwritten."""
    out = _folder(output_dir)
    annotation, review = out / "agent_episode_annotation.csv", out / "agent_episode_review.md"
    if annotation.exists():
        io.unannotated(spark.read.option("header", True).csv(str(annotation)))
    io.unticked(str(review))
    with io.only_read(spark, messages, mapping):
        rows = _roled(spark, messages, mapping)
        if rows.where("role = 'AGENT'").isEmpty():
            raise ValueError("the mapping names no agent with a message")
        found = persisted(graph.ancestors(rows))
        pool = persisted(audits.pooled(rows, found))
        labels, made = persisted(audits.episodes(pool)), persisted(audits.features(rows, found))
        members = persisted(audits.episode_members(pool, labels))
        if not audits.overlaps(members.join(pool.select("message_id", "topic"), "message_id")).isEmpty():
            raise ValueError("episodes overlap")
        table = persisted(audits.episode_table(pool, labels))
        why = audits.provenance(pool, labels).groupBy("episode").agg(F.collect_list(F.struct("message_id", "anchor", "gap_seconds", "outside_60m", "reasons")).alias("context_provenance"))
        refs = audits.system_references(rows, pool, labels).groupBy("episode").agg(F.array_sort(F.collect_list("message_id")).alias("system_references"))
        stats = audits.statistics(made, table)
        io.write_csv(made.join(labels, made["message_id"] == labels["anchor"]).drop("anchor").orderBy("message_id"), str(out / "agent_messages.csv"))
        io.write_csv(audits.annotation(table).orderBy("episode"), str(annotation))
        replaced(nested(members, rows, table.join(why, "episode").join(refs, "episode", "left"), ["episode"]), str(out / "agent_episodes.jsonl"))
        io.write_markdown("Episodes of agent messages", {"Episodes": table.orderBy("episode")}, str(review))
        io.write_markdown("Agent messages", {"Figures": stats.orderBy("figure", "key")}, str(out / "agent_audit_report.md"))
        report = _rows(stats.orderBy("figure", "key"))
        io.write_json(report, str(out / "agent_statistics.json"))
    return report


def validate_raw(spark: SparkSession, input_dir: str, messages: str, segmentation_dir: str, output_dir: str) -> dict:
    """The pages read a second time by another parser, and compared with the messages field by field."""
    with io.only_read(spark, input_dir, messages):
        raw = persisted(pages.lenient(pages.read_pages(spark, input_dir)))
        rows = persisted(read_messages(spark, messages))
        compared = persisted(pages.reconciled(raw, rows))
        report = _row(pages.validation_summary(raw, rows, compared))
        out = _folder(output_dir)
        sample = pages.parser_sample(compared).join(compared, ["source_file", "message_id"])
        io.write_csv(sample.orderBy("source_file", "message_id"), str(out / "parser_sample_validation.csv"))
        files = rows.select("message_id", F.explode("attachments").alias("a")).select("message_id", "a.*")
        io.write_csv(files, str(out / "attachment_validation.csv"))
        io.write_csv(rows.where("message_type = 'message'").groupBy("sender").agg(F.count("*").alias("message_count")).orderBy(F.desc("message_count"), "sender"), str(out / "sender_distribution.csv"))
        edges, figures_ = persisted(graph.direct_edges(graph.parents(rows))), []
        for t in segmentation.THRESHOLDS:
            own = persisted(read_conversations(spark, os.path.join(segmentation_dir, f"segmentation_{t}m.jsonl")))
            size = own.join(rows.select("message_id", "sender"), "message_id").groupBy("conversation_id").agg(F.count("*").alias("n"), F.countDistinct("sender").alias("senders"))
            line = _row(size.agg(F.count("*").alias("conversation_count"), F.count_if(F.col("n") == 1).alias("single_message_count"), F.percentile("n", F.lit(0.5)).alias("median_messages"), F.percentile("n", F.lit(0.9)).alias("p90_messages"), F.max("n").alias("max_messages"), F.avg((F.col("senders") > 1).cast("int")).alias("multi_sender_ratio")))
            normal = rows.where("message_type = 'message'")
            figures_.append(line | {"threshold": t, "direct_reply_edges": edges.count(), "broken_direct_reply": checks.broken_replies(edges, own).count(), "long_reply_edges": edges.where("gap_seconds > 86400").count(), "all_messages_preserved": checks.incomplete_partition(normal, own).isEmpty()})
        io.write_json(report | {"thresholds": figures_}, str(out / "raw_verification.json"))
    return report | {"thresholds": figures_}


def run_all(spark: SparkSession, input_dir: str, output_dir: str, mapping: str | None = None, earlier: str | None = None) -> list[dict]:
    """All stages in turn, up to the first that fails: (stage, exit_code, error). The input's files are compared by hash before and after.

    Without a mapping the stages that need roles are left out. earlier names the output of another run, with which
    the message tables are compared row by row.
    """
    at = lambda *x: os.path.join(output_dir, *x)
    before, runs = io.manifest(spark, input_dir), []
    jobs: list[tuple[str, Callable[[], object]]] = [
        ("preprocess", lambda: _clean(preprocess(spark, input_dir, at("messages.jsonl")))),
        ("profile", lambda: profile(spark, at("messages.jsonl"), at("analysis"))),
        ("segment", lambda: segment(spark, at("messages.jsonl"), at("segmentation"))),
        ("singletons", lambda: singletons(spark, at("segmentation", "segmentation_60m.jsonl"), at("messages.jsonl"), at("singles"))),
        ("roles", lambda: roles(spark, at("messages.jsonl"), at("roles"))),
        ("validate_raw", lambda: validate_raw(spark, input_dir, at("messages.jsonl"), at("segmentation"), at("validation"))),
    ]
    if mapping:
        jobs += [
            ("reconstruct", lambda: reconstruct(spark, at("segmentation", "segmentation_60m.jsonl"), at("messages.jsonl"), mapping, at("reconstruction"))),
            ("audit", lambda: audit(spark, at("messages.jsonl"), mapping, at("agent_audit"))),
        ]
    for name, job in jobs:
        try:
            job()
            runs.append({"stage": name, "exit_code": 0, "error": None})
        except (ValueError, RuntimeError) as error:
            runs.append({"stage": name, "exit_code": 1, "error": str(error)})
            break
    if io.manifest(spark, input_dir) != before:
        raise RuntimeError("the input changed meanwhile")
    if earlier:
        same = io.same_rows(read_messages(spark, at("messages.jsonl")), read_messages(spark, os.path.join(earlier, "messages.jsonl")))
        runs.append({"stage": "comparison", "exit_code": 0 if same else 1, "error": None if same else "the messages differ from those of the earlier run"})
    io.write_json(runs, at("run_manifest.json"))
    return runs


def _clean(report: dict) -> dict:
    if report["errors"]:
        raise ValueError(f"{report['errors']} errors in the pages")
    return report


#: Commands: the function and its options; a default of ... means that the option must be given.
COMMANDS: dict[str, tuple[Callable, dict]] = {
    "preprocess": (preprocess, {"input_dir": ".", "output": ...}),
    "profile": (profile, {"input": ..., "output_dir": ..., "seed": SEED}),
    "segment": (segment, {"input": ..., "output_dir": ..., "seed": SEED}),
    "singletons": (singletons, {"segmentation_path": ..., "messages": ..., "output_dir": ..., "seed": SEED}),
    "roles": (roles, {"input": ..., "output_dir": ..., "evidence_sender": None, "seed": SEED}),
    "reconstruct": (reconstruct, {"baseline": ..., "messages": ..., "mapping": ..., "output_dir": ..., "seed": SEED}),
    "audit": (audit, {"messages": ..., "mapping": ..., "output_dir": ...}),
    "validate_raw": (validate_raw, {"input_dir": ..., "messages": ..., "segmentation_dir": ..., "output_dir": ...}),
    "all": (run_all, {"input_dir": ..., "output_dir": ..., "mapping": None, "earlier": None}),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; 0 if it did what it should, 1 if its input or output breaks a rule."""
    parser = argparse.ArgumentParser(prog="colloquy.stages")
    choose = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        own = choose.add_parser(name)
        for option, default in options.items():
            own.add_argument("--" + option.replace("_", "-"), required=default is ..., default=None if default is ... else default, type=int if isinstance(default, int) else str)
    given = vars(parser.parse_args(argv))
    run, _ = COMMANDS[given.pop("command")]
    try:
        result = run(spark or SparkSession.builder.getOrCreate(), **given)
    except (ValueError, RuntimeError) as error:
        print(error, file=sys.stderr)
        return 1
    if run is preprocess:
        return 1 if result["errors"] else 0
    return 1 if run is run_all and any(r["exit_code"] for r in result) else 0


if __name__ == "__main__":
    sys.exit(main())
