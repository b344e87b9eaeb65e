"""The whole way from an export to a run plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MoveOptions
from ..operators import execute, journal, plan
from ..sources import files, jsonl


def make(spark: SparkSession, export: str, o: MoveOptions) -> DataFrame:
    """Operations of an export; one unsafe row is an error."""
    files.check_roots(o.source_root, o.dest_root)
    rows = jsonl.read_numbered(spark, export)
    bad = rows.where(plan.included(o)).select("path", plan.violation(o).alias("why")).where("why is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['path']!r}: {bad[0]['why']}")
    root, dest = o.source_root, o.dest_root

    def linked(batches):
        for pdf in batches:
            yield pdf[[files.has_link(s, root) or files.has_link(d, dest) for s, d in zip(pdf["source"], pdf["destination"])]]

    ops = plan.operations(rows, o)
    hit = ops.select("source", "destination").mapInPandas(linked, "source string, destination string").limit(1).collect()
    if hit:
        raise ValueError(f"{hit[0]['source']!r}: a path leads through a link")
    return ops


def resume(spark: SparkSession, ops: DataFrame, journal_path: str, o: MoveOptions) -> DataFrame:
    entries = jsonl.read_journal(spark, journal_path)
    return journal.resume(ops, entries, execute.prove_destinations(ops), o.mode.value)


def run(ops: DataFrame, o: MoveOptions, journal_path: str | None = None) -> DataFrame:
    done = execute.execute(ops, o)
    if journal_path and not o.dry_run:
        import datetime as dt

        jsonl.append_journal(journal.entries(done, o.mode.value, dt.datetime.now()), journal_path)
    return done


def summary(done: DataFrame) -> str:
    r = plan.execution_counters(done).first()
    return ", ".join(f"{k} {r[k]}" for k in ("succeeded", "resumed", "failed", "skipped", "bytes")) if r else ""


def by_status(done: DataFrame) -> DataFrame:
    return done.groupBy("status").agg(F.count("*").alias("files"))
