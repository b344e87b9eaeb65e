"""Categories, target folders, asset and thumbnail marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DateLayout, OrganizeOptions
from ..functions import dates, paths


def image_category(thumb: Column, asset: Column, has_image: Column, ext: Column) -> Column:
    """Images with image facts go by their marks, everything else by type."""
    marked = F.when(thumb, "images/thumbnails").when(asset, "images/assets").otherwise("images/originals")
    return F.when(has_image, marked).otherwise(paths.category(ext))


def is_asset(has_exif: Column, width: Column, height: Column, size: Column) -> Column:
    return ~has_exif & (((width <= 128) & (height <= 128)) | (size < 10_000))


def is_thumbnail(has_exif: Column, path: Column, size: Column) -> Column:
    return ~has_exif & F.startswith(F.lower(paths.basename(path)), F.lit("t")) & (size < 50_000)


def classify(files: DataFrame, o: OrganizeOptions | None = None) -> DataFrame:
    """Adds target_path to rows with type, mtime and, where known, image_exif and additional_info."""
    o = o or OrganizeOptions()
    ext = F.col("type")
    if "image_exif" in files.columns:
        i = F.col("image_exif")
        cat = image_category(F.coalesce(i["IsThumb"], F.lit(False)), F.coalesce(i["IsAsset"], F.lit(False)), i.isNotNull(), ext)
    else:
        cat = paths.category(ext)
    if o.layout == DateLayout.NONE:
        return files.withColumn("target_path", cat)
    meta = F.col("additional_info") if "additional_info" in files.columns else None
    valid, time = (meta["valid"], meta["time"]) if meta is not None else (F.lit(False), F.lit(None).cast("timestamp"))
    when = dates.file_date(valid, time, F.col("mtime"), o.source)
    return files.withColumn("target_path", F.when(paths.is_media_category(cat), dates.organized(cat, when, o)).otherwise(cat))
