"""Scans: directory rows to result rows."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanOptions
from ..functions import detect, paths
from ..functions.media import file_meta, image
from ..functions.validate import validate
from ..schema import META
from ..sources.files import files, read_range
from ..streaming.incremental import scratch
from .classify import classify, is_asset, is_thumbnail
from .dedup import repeated

BLOCK, SMALL = 64 << 10, 256 << 10
FACTS = f"path STRING, type STRING, meta STRUCT<{META.replace(' STRING', ':STRING').replace(' TIMESTAMP', ':TIMESTAMP').replace(' BOOLEAN', ':BOOLEAN').replace(' MAP', ':MAP')}>, image STRUCT<Width:INT,Height:INT,HasExif:BOOLEAN,Exif:STRUCT<date_taken:STRING,camera_model:STRING,lat:DOUBLE,lon:DOUBLE>>, quick_hash STRING, full_hash STRING"


def full_hash(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def quick_hash(path: str, size: int | None = None) -> str:
    """Whole if small; else of the first and last 64 KiB and the size (8 bytes, big-endian)."""
    size = os.path.getsize(path) if size is None else size
    if size <= SMALL:
        return full_hash(path)
    return hashlib.sha256(read_range(path, 0, BLOCK) + read_range(path, -BLOCK, BLOCK) + size.to_bytes(8, "big")).hexdigest()


def detect_file(path: str) -> str:
    try:
        head = read_range(path, 0, detect.PATTERN_HEAD)
    except FileNotFoundError:
        return "Error opening file"
    except OSError:
        return "Error reading file"
    return detect.detect_bytes(path, head)


def facts(found: DataFrame, o: ScanOptions) -> DataFrame:
    """type, meta, image and hashes of each path: one Python pass, so that a file is opened where it is and nothing runs twice."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, size in zip(pdf["path"], pdf["size"]):
                kind = detect_file(p)
                kind = kind.lower() if o.normalize_ext and not kind.startswith("Error") else kind
                meta, img, quick, whole = file_meta(p, kind), None, None, None
                try:
                    if kind in paths.IMAGE_TYPES and (i := image(read_range(p, 0, 256 << 10), o.image_without_exif)):
                        img = {k: i[k] for k in ("Width", "Height", "HasExif", "Exif")}
                    quick = quick_hash(p, int(size)) if o.hash else None
                    whole = full_hash(p) if o.full_hash else None
                except OSError:
                    pass
                if not o.keep_map:
                    meta["additional_info"] = {}
                rows.append((p, kind, meta, img, quick, whole))
            yield pd.DataFrame(rows, columns=["path", "type", "meta", "image", "quick_hash", "full_hash"])

    return found.select("path", "size").mapInPandas(run, FACTS)


def scan(spark: SparkSession, root: str, o: ScanOptions | None = None, done: DataFrame | None = None) -> DataFrame:
    """RESULT rows (with mtime) of a tree; paths in `done` are left out before any file is opened."""
    o = o or ScanOptions()
    found = files(spark, root)
    if done is not None:
        found = found.join(done.select("path").distinct(), "path", "left_anti")
    rows = found.join(facts(found, o).withColumnRenamed("path", "p"), F.col("path") == F.col("p")).drop("p")
    i = F.col("image")
    asset = is_asset(i["HasExif"], i["Width"], i["Height"], F.col("size"))
    thumb = is_thumbnail(i["HasExif"], F.col("path"), F.col("size"))
    rows = rows.withColumn("image_exif", F.when(i.isNotNull(), F.struct(i["Width"].alias("Width"), i["Height"].alias("Height"), i["HasExif"].alias("HasExif"), i["Exif"].alias("Exif"), thumb.alias("IsThumb"), asset.alias("IsAsset"), F.lit("").alias("Reason"))))
    rows = rows.withColumnRenamed("meta", "additional_info").drop("image")
    if o.validate:
        asked = rows.where(paths.should_validate(F.col("type"), o.validate)).select("path")
        v = validate(asked).select(F.col("path").alias("p"), "valid", F.when(~F.col("valid"), F.concat("error.type", F.lit(": "), "error.message")).alias("validation_error"), F.col("details").alias("valid_details"))
        rows = rows.join(v, F.col("path") == F.col("p"), "left").drop("p")
    else:
        rows = rows.withColumn("valid", F.lit(None).cast("boolean")).withColumn("validation_error", F.lit(None).cast("string")).withColumn("valid_details", F.lit(None).cast("map<string,string>"))
    rows = classify(rows, o.organize)
    return rows.select("path", "size", "type", "image_exif", "error", "target_path", "additional_info", "quick_hash", "full_hash", "valid", "validation_error", "valid_details", "mtime")


def scan_counts(spark: SparkSession, root: str) -> DataFrame:
    """Files by type alone."""
    return facts(files(spark, root), ScanOptions()).groupBy("type").agg(F.count("*").alias("files"))


def unchanged(path: str, size: int, micros) -> bool:
    """Whether a file still has the size and time it was scanned with."""
    s = os.stat(path)
    return s.st_size == size and micros is not None and abs(s.st_mtime_ns // 1000 - micros) <= 1


def staged_hashes(found: DataFrame, min_size: int = 0) -> DataFrame:
    """path, size, full_hash of files that may have a duplicate: sizes first, then quick hashes, then whole files.

    Rows that carry a quick_hash and mtime keep the hash if the file is unchanged; small files' quick hash is their full one.
    """
    known = F.col("quick_hash") if "quick_hash" in found.columns else F.lit(None).cast("string")
    micros = F.unix_micros("mtime") if "mtime" in found.columns else F.lit(None).cast("long")
    same_size = repeated(found.where(F.col("size") >= min_size).select("path", "size", known.alias("known"), micros.alias("micros")), "size")

    def quick(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, size, have, at in zip(pdf["path"], pdf["size"], pdf["known"], pdf["micros"]):
                try:
                    out.append(have if have and not pd.isna(at) and unchanged(p, int(size), int(at)) else quick_hash(p))
                except OSError:
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "size": pdf["size"], "quick_hash": out})

    def whole(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, size, have in zip(pdf["path"], pdf["size"], pdf["quick_hash"]):
                try:
                    out.append(have if size <= SMALL else full_hash(p))
                except OSError:
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "size": pdf["size"], "full_hash": out})

    # Written, not cached: a later call over the same rows must look at the files again.
    path = f"{scratch(found.sparkSession)}/quick-{uuid.uuid4().hex}"
    same_size.mapInPandas(quick, "path string, size long, quick_hash string").where("quick_hash is not null").write.parquet(path)
    hashed = found.sparkSession.read.parquet(path)
    cand = repeated(hashed, "size", "quick_hash")
    return cand.select("path", "size", "quick_hash").mapInPandas(whole, "path string, size long, full_hash string").where("full_hash is not null")
