"""Operation journals and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

VERSION = 1
ACTIONS = ["copy", "move", "hardlink", "symlink"]
TERMINAL = ["success", "failed", "skipped", "conflict"]


def entry_error() -> Column:
    """What is wrong with a journal row; null if nothing."""
    return (
        F.when(F.coalesce(F.col("schema_version"), F.lit(0)) != VERSION, "unsupported version")
        .when(F.col("timestamp").isNull(), "no timestamp")
        .when(~F.coalesce(F.col("action"), F.lit("")).isin(ACTIONS), "unknown action")
        .when(F.coalesce(F.col("size"), F.lit(0)) < 0, "negative size")
        .when((F.coalesce(F.col("sha256"), F.lit("")) != "") & ~paths.is_full_sha256(F.col("sha256")), "not a full hash")
        .when(~F.coalesce(F.col("status"), F.lit("")).isin(TERMINAL), "status not final")
    )


def resume(ops: DataFrame, journal: DataFrame, dest_hash: DataFrame, action: str) -> DataFrame:
    """ops with resumed and unverified.

    A pending operation is resumed if a successful entry has its action, source, destination and
    size, the hashes are full and equal whatever their case, and the destination's content (from
    dest_hash: destination, dest_size, dest_sha) proves it; with an entry but no proof it is unverified.
    """
    won = journal.where("status = 'success'").where(F.col("action") == action)
    won = won.groupBy("source", "destination", "size").agg(F.collect_set(F.lower("sha256")).alias("hashes"), F.count("*").alias("entries"))
    joined = ops.join(won, ["source", "destination", "size"], "left").join(dest_hash, "destination", "left")
    h = F.lower("hash")
    proof = paths.is_full_sha256(F.col("hash")) & F.array_contains("hashes", h) & (F.col("dest_size") == F.col("size")) & (F.lower("dest_sha") == h)
    pending, met = F.col("status") == "pending", F.col("entries").isNotNull()
    resumed = pending & met & F.coalesce(proof, F.lit(False))
    out = joined.withColumn("resumed", resumed).withColumn("unverified", pending & met & ~resumed)
    return out.withColumn("status", F.when(resumed, "success").otherwise(F.col("status"))).drop("hashes", "entries", "dest_size", "dest_sha")


def resume_report(resumed: DataFrame) -> DataFrame:
    return resumed.agg(F.count_if("resumed").alias("resumed"), F.count_if("unverified").alias("unverified"))


def entries(done: DataFrame, action: str, now) -> DataFrame:
    """Journal rows of finished operations."""
    end = F.coalesce(F.col("end_time"), F.lit(now).cast("timestamp"))
    return done.where(F.col("status").isin(TERMINAL)).select(F.lit(VERSION).alias("schema_version"), end.alias("timestamp"), F.lit(action).alias("action"), "source", "destination", "size", F.col("hash").alias("sha256"), "status", "error")
