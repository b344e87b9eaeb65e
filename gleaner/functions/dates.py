"""Dates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DateLayout, DateSource, OrganizeOptions

FIRST_YEAR, LAST_YEAR = 1990, 2100
LAYOUTS = {DateLayout.YEAR: "yyyy", DateLayout.YEAR_MONTH: "yyyy/MM", DateLayout.YEAR_MONTH_DAY: "yyyy/MM/dd"}


def date_folder(time: Column, layout: DateLayout, unknown: str = "unknown_date") -> Column:
    """yyyy, yyyy/MM or yyyy/MM/dd; the unknown folder for null dates and years outside 1990..2100."""
    if layout == DateLayout.NONE:
        return F.lit("")
    return F.when(F.year(time).between(FIRST_YEAR, LAST_YEAR), F.date_format(time, LAYOUTS[layout])).otherwise(F.lit(unknown))


def file_date(meta_valid: Column, meta_time: Column, mtime: Column, source: DateSource) -> Column:
    meta = F.when(meta_valid, meta_time)
    return {DateSource.AUTO: F.coalesce(meta, mtime), DateSource.METADATA: meta, DateSource.FILESYSTEM: mtime}[source]


def organized(category: Column, time: Column, o: OrganizeOptions) -> Column:
    if o.layout == DateLayout.NONE:
        return category
    folder = date_folder(time, o.layout, o.unknown)
    return F.concat_ws("/", category, folder) if o.with_category else folder


def date_info(valid: Column, time: Column, source: Column) -> Column:
    """One line on a date and where it came from."""
    return F.when(valid, F.concat(F.date_format(time, "yyyy-MM-dd"), F.lit(" ("), source, F.lit(")"))).otherwise("no date")


def exif_date(text: Column) -> Column:
    """Four layouts; null where none fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd", "yyyy-MM-dd")])


def custom_format(time: Column, pattern: str) -> Column:
    """YYYY YY MM DD HH mm ss, the longest token first; other text stands as it is."""
    tokens, out, i = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}, [], 0
    while i < len(pattern):
        token = next((t for t in tokens if pattern.startswith(t, i)), None)
        out.append(F.date_format(time, tokens[token]) if token else F.lit(pattern[i]))
        i += len(token) if token else 1
    return F.concat(*out) if out else F.lit("")
