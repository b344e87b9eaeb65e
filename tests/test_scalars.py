import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import dates, detect, paths
from gleaner.functions.templates import PRESETS, Template, sanitized


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("size, text", [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (1024**2, "1.00 MB"), (1024**3, "1.00 GB")])
def test_readable_size(spark, size, text):
    assert one(spark, paths.readable_size(F.lit(size).cast("long"))) == text


@pytest.mark.parametrize("ext, folder", [("mp4", "videos/mp4"), ("docx", "documents/text/docx"), ("go", "code/go/go"), ("xyz123", "others/xyz123"), ("prproj", "video-projects/premiere"), ("JPG", "others/JPG")])
def test_category(spark, ext, folder):
    assert one(spark, paths.category(F.lit(ext))) == folder


def test_category_count_and_register(spark):
    assert len(paths.categories()) == 239
    paths.register_category("zzz", "own/zzz")
    try:
        assert one(spark, paths.category(F.lit("zzz"))) == "own/zzz"
    finally:
        paths._registered.clear()


@pytest.mark.parametrize("day, layout, folder", [("2024-01-15", "ym", "2024/01"), ("2024-06-15", "y", "2024"), ("2024-01-05", "ymd", "2024/01/05"), ("1980-01-01", "ym", "unknown_date"), ("2150-01-01", "ym", "unknown_date"), (None, "ym", "unknown_date")])
def test_date_folder(spark, day, layout, folder):
    assert one(spark, dates.date_folder(F.lit(day).cast("timestamp"), config.DateLayout.parse(layout))) == folder


@pytest.mark.parametrize("text, want", [("off", "none"), ("", "none"), ("YYYY", "year"), ("yearmonth", "year-month"), ("YYYY/MM/DD", "year-month-day"), ("whatever", "year-month")])
def test_layout_spellings(text, want):
    assert config.DateLayout.parse(text).value == want


def test_strict_and_lenient_enums():
    assert config.Keep.parse("short") == config.Keep.SHORTEST and config.Keep.parse("?") == config.Keep.SHORTEST
    assert config.Action.parse("rm") == config.Action.DELETE and config.Action.parse("?") == config.Action.DRY_RUN
    with pytest.raises(ValueError):
        config.Mode.parse("burn")
    assert config.size_of("5MB") == 5 << 20 and config.size_of("12") == 12 and config.workers(99) == 32


@pytest.mark.parametrize(
    "name, data, want",
    [("a.jpg", bytes.fromhex("FFD8FFE000104A464946"), "jpg"), ("x", bytes.fromhex("89504E470D0A1A0A"), "png"), ("x", b"%PDF-1.4", "pdf"), ("x", bytes.fromhex("504B0304"), "zip"), ("a.txt", b"", "txt"), ("a", b"", "unknown"), ("a", b'{"key": "value"}', "json"), ("a", b"[1, 2, 3]", "json"), ("a", b"\0\1\2\3", "binary"), ("a", b"plain", "unknown"), ("a.Foo", b"plain", "Foo"), ("a", b"RIFF1234", "unknown")],
)
def test_detect(name, data, want):
    assert detect.detect_bytes(name, data) == want


def test_pattern_columns_agree_with_bytes(spark):
    from gleaner.catalogue import SYNTH

    rows = spark.createDataFrame([(x,) for x in SYNTH], "t string").select("t", detect.pattern_type(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in rows] == [detect.pattern_bytes(x.encode()) for x in SYNTH]


def test_templates(spark):
    assert Template.parse("{date}_{seq:4}.{ext}").variables() == ["date", "seq", "ext"]
    assert all(Template.preset(p) for p in PRESETS)
    with pytest.raises(ValueError):
        Template.parse("{does_not_exist}")
    assert one(spark, sanitized(F.lit("a<b>:  c?.jpg "))) == "a_b__ c_.jpg"
    assert one(spark, sanitized(F.lit("con.txt"))) == "_con.txt"
    long = one(spark, sanitized(F.lit("x" * 300 + ".jpg")))
    assert len(long) == 255 and long.endswith(".jpg")


def test_exif_dates(spark):
    for text in ("2024:01:15 14:30:52", "2024-01-15 14:30:52"):
        assert one(spark, dates.exif_date(F.lit(text))) == dt.datetime(2024, 1, 15, 14, 30, 52)
    assert one(spark, dates.exif_date(F.lit("never"))) is None
    assert one(spark, dates.custom_format(F.lit("2024-01-15 14:30:52").cast("timestamp"), "YYYY-YY_HHmmss")) == "2024-24_143052"
