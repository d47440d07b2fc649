"""Reading and writing around the message table: the whole first stage, CSV, JSON and Markdown reports, guards."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators import checks
from colloquy.operators.audit import MANUAL
from colloquy.operators.graph import persisted
from colloquy.sources import pages
from colloquy.sources.messages import read_messages, write_messages

MAPPING = "sender string, role string, confidence string, notes string"


def outside(path: str, protected: str) -> str:
    """path; ValueError if it lies within protected."""
    if Path(path).resolve().is_relative_to(Path(protected).resolve()):
        raise ValueError(f"{path} is within {protected}, which is only read")
    return path


def preprocess(spark: SparkSession, folder: str, output: str, raw: str | None = None) -> dict:
    """Pages of a folder to a message table in output; returns the report's counts.

    With an error of any kind (structure, a repeated id, time going back) nothing is written. Pages that change
    while they are read raise RuntimeError.
    """
    outside(output, raw or folder)
    source = pages.read_pages(spark, folder)
    before = {r["source_file"]: r["sha256"] for r in source.select("source_file", "sha256").collect()}
    if not before:
        raise ValueError("no messages*.html found")
    found, errors, warnings = pages.messages(persisted(pages.parsed(source)))
    found = persisted(found)
    faults = errors.unionByName(checks.duplicate_ids(found).select(F.lit(None).cast("string").alias("source_file"), "message_id", F.lit("repeated message id").alias("reason"))).unionByName(checks.chronology_violations(found).limit(1).select(F.lit(None).cast("string").alias("source_file"), "message_id", F.lit("time goes back").alias("reason")))
    faults = persisted(faults)
    lost = checks.missing_reply_targets(found).count()
    written = write_messages(found, output, faults)
    if {r["source_file"]: r["sha256"] for r in pages.read_pages(spark, folder).select("source_file", "sha256").collect()} != before:
        raise RuntimeError("the pages changed meanwhile")
    return checks.summary(found).first().asDict() | {"errors": faults.count(), "warnings": warnings.count() + lost, "written": written, "source_sha256": before}


def flat(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a byte-order mark, for spreadsheets; rows come to the driver one partition at a time."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        w.writerows(flat(df).toLocalIterator())


def write_csv_folder(df: DataFrame, path: str) -> None:
    """CSV part files, written by the executors, for tables of any size."""
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A role mapping; a byte-order mark at its start is no part of the first name."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[F.coalesce(F.col(f.split()[0]) if f.split()[0] in df.columns else F.lit(""), F.lit("")).alias(f.split()[0]) for f in MAPPING.split(", ")])


def write_json(value: dict | list, path: str) -> None:
    """A report, moved into place when it is complete."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=str)
    os.replace(path + ".tmp", path)


def write_markdown(title: str, tables: dict[str, DataFrame], path: str) -> None:
    """A report of tables, each with all its rows."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# {title}\n")
        for name, df in tables.items():
            f.write(f"\n## {name}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n")
            for r in flat(df).toLocalIterator():
                f.write("| " + " | ".join(str("" if v is None else v).replace("|", "\\|").replace("\n", " ") for v in r) + " |\n")


def unannotated(existing: DataFrame) -> None:
    """ValueError if people have filled in any column of MANUAL."""
    if not existing.where(" or ".join(f"coalesce({c}, '') <> ''" for c in MANUAL)).isEmpty():
        raise ValueError("the annotation has been filled in; it is not overwritten")


def unticked(path: str) -> None:
    """ValueError if people have ticked anything in a review."""
    if os.path.exists(path) and re.search(r"\[[xX]\]", Path(path).read_text(encoding="utf-8")):
        raise ValueError("the review has ticks; it is not overwritten")


def listing(spark: SparkSession, path: str) -> dict[str, tuple]:
    """Length and time of change of each file of a path; cheap whatever their size, as no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return {r["path"]: (r["length"], r["modificationTime"]) for r in files.select("path", "length", "modificationTime").collect()}


@contextmanager
def only_read(spark: SparkSession, *paths: str) -> Iterator[None]:
    """RuntimeError if the files of the paths are not the same afterwards."""
    before = [listing(spark, p) for p in paths]
    yield
    if [listing(spark, p) for p in paths] != before:
        raise RuntimeError("the input changed meanwhile")


def manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """sha256 of each file below a folder, for comparing before and after."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return {r["path"]: r["h"] for r in files.select("path", F.sha2("content", 256).alias("h")).collect()}


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


__all__ = ["flat", "listing", "manifest", "only_read", "outside", "preprocess", "read_mapping", "read_messages", "same_rows", "unannotated", "unticked", "write_csv", "write_csv_folder", "write_json", "write_markdown"]
