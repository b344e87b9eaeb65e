"""Exact duplicates: groups, the staged cascade, the copy to keep, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Keep
from ..functions import paths


def duplicate_groups(files: DataFrame, key: str = "full_hash", min_size: int = 0) -> DataFrame:
    """hash, size, count, paths (ascending), wasted_space of each hash that several files share.

    Lists are gathered only for keys counted twice or more, so that unique files never carry arrays."""
    f = files.where((F.col("size") >= min_size) & F.col(key).isNotNull())
    g = f.groupBy(F.col(key).alias("hash")).agg(F.first("size").alias("size"), F.count("*").cast("int").alias("count"), F.array_sort(F.collect_list("path")).alias("paths"))
    return g.where("count > 1").withColumn("wasted_space", F.col("size") * (F.col("count") - 1))


def duplicate_stats(files: DataFrame, key: str = "full_hash", min_size: int = 0) -> DataFrame:
    """As duplicate_groups() without paths: fixed-size rows however many copies a group has."""
    f = files.where((F.col("size") >= min_size) & F.col(key).isNotNull())
    g = f.groupBy(F.col(key).alias("hash")).agg(F.first("size").alias("size"), F.count("*").alias("count"))
    return g.where("count > 1").withColumn("wasted_space", F.col("size") * (F.col("count") - 1))


def duplicate_report(files: DataFrame, key: str = "full_hash", min_size: int = 0) -> DataFrame:
    """One row of counts."""
    small = files.agg(F.count("*").alias("total_files"), F.count_if(F.col("size") < min_size).alias("skipped_small_files"))
    g = duplicate_stats(files, key, min_size).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_files"), F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("wasted_space"), F.lit(0)).alias("wasted_space_bytes"))
    both = small.crossJoin(g)  # one row each
    return both.withColumn("unique_files", F.col("total_files") - F.col("duplicate_files") + F.col("duplicate_groups") - F.col("skipped_small_files"))


def repeated(files: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys occur twice or more: a counted semi join, without a window over whole groups."""
    many = files.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return files.join(many, list(keys), "left_semi")


def staged_candidates(files: DataFrame, quick: Column, min_size: int = 0) -> DataFrame:
    """Size, then quick hash: what is left needs its full hash read."""
    by_size = repeated(files.where(F.col("size") >= min_size), "size")
    return repeated(by_size.withColumn("quick_hash", quick), "size", "quick_hash")


def quick_hash_text(text: Column, block: int, small: int) -> Column:
    """The quick hash over a string's characters: whole if short, else head, tail and length."""
    n = F.length(text)
    return F.when(n <= small, F.sha2(text, 256)).otherwise(F.sha2(F.concat(F.substring(text, 1, block), F.right(text, F.lit(block)), F.lpad(F.hex(n.cast("long")), 16, "0")), 256))


def keep_order(keep: Keep, priority: list[str] | None = None) -> list[Column]:
    """Sort keys whose first row is the copy to keep."""
    shortest = [F.octet_length("path"), F.col("path")]
    if keep == Keep.FIRST:
        return [F.col("path")]
    if keep == Keep.SHORTEST:
        return shortest
    if keep == Keep.OLDEST:
        return [F.col("mtime").asc_nulls_last(), F.col("path")]
    if keep == Keep.NEWEST:
        return [F.col("mtime").desc_nulls_last(), F.col("path")]
    rank = F.lit(len(priority or []))
    for k, folder in reversed(list(enumerate(priority or []))):
        rank = F.when(paths.within(F.col("path"), folder), k).otherwise(rank)
    return [rank, *shortest]


def kept(files: DataFrame, keep: Keep, priority: list[str] | None = None, key: str = "full_hash") -> DataFrame:
    """hash, keep_path, count of each group: a mergeable arg-min, so that a huge group is never sorted in one task."""
    order = keep_order(keep, priority)
    low = []
    for k, c in enumerate(order):
        if k == 0 and keep in (Keep.OLDEST, Keep.NEWEST):
            t = F.unix_micros("mtime") * (1 if keep == Keep.OLDEST else -1)
            low.append(F.coalesce(t, F.lit((1 << 63) - 1)).alias("k0"))
        else:
            low.append(c.alias(f"k{k}"))
    g = files.groupBy(F.col(key).alias("hash")).agg(F.min(F.struct(*low, F.col("path").alias("p"))).alias("m"), F.count("*").alias("count"))
    return g.where("count > 1").select("hash", F.col("m.p").alias("keep_path"), "count")


def actions(files: DataFrame, keep: Keep, priority: list[str] | None = None, key: str = "full_hash") -> DataFrame:
    """path, keep_path, hash, size of each copy to act upon."""
    k = kept(files, keep, priority, key).select("hash", "keep_path")
    return files.join(k, files[key] == k["hash"]).where("path <> keep_path").select("path", "keep_path", "hash", "size")


def action_report(acts: DataFrame) -> DataFrame:
    return acts.agg(F.countDistinct("hash").alias("groups"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("space_saved"))
