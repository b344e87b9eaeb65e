import datetime as dt
import struct

import pytest

from gleaner.functions import media, validate


@pytest.mark.parametrize("data, want", [("7BA9", (0x7BA9, 2)), ("18538067", (0x18538067, 4)), ("1549A966", (0x1549A966, 4)), ("", (0, 0))])
def test_ebml_id(data, want):
    assert media.ebml_id(bytes.fromhex(data)) == want


@pytest.mark.parametrize("data, want", [("FF", (127, 1)), ("8A", (10, 1)), ("43E8", (1000, 2)), ("", (0, 0))])
def test_ebml_size(data, want):
    assert media.ebml_size(bytes.fromhex(data)) == want


@pytest.mark.parametrize("name, title", [("My_Movie_2021.mkv", "My Movie 2021"), ("Movie.Name.720p.mkv", "Movie Name 720p"), ("file-with-dashes.mkv", "file with dashes"), ("test.mkv", "test"), ("recup_dir.mkv", "")])
def test_mkv_file_name(name, title):
    assert media.mkv(b"", name)["original_name"] == title


def element(ident: str, body: bytes) -> bytes:
    return bytes.fromhex(ident) + (len(body) | 1 << 28).to_bytes(4, "big") + body


def mkv_file() -> bytes:
    info = element("7BA9", b"Title\0") + element("4461", (10**9 * 86400).to_bytes(8, "big"))
    return element("1A45DFA3", b"\x42\x86\x81\x01") + element("18538067", element("1549A966", info))


def test_mkv_info():
    m = media.mkv(mkv_file())
    assert (m["original_name"], m["time"]) == ("Title", dt.datetime(2001, 1, 2))


def box(kind: bytes, body: bytes) -> bytes:
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def mp4_file() -> bytes:
    made = int((dt.datetime(2020, 5, 1) - media.MP4_EPOCH).total_seconds())
    mvhd = b"\0" * 4 + struct.pack(">IIII", made, made, 1000, 5000) + b"\0" * 80
    tkhd = b"\0" * 76 + struct.pack(">II", 640 << 16, 480 << 16)
    title = box(b"udta", box(b"meta", b"\0" * 4 + box(b"ilst", box(b"\xa9nam", box(b"data", b"\0" * 8 + b"Clip")))))
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", b"xx") + box(b"moov", box(b"mvhd", mvhd) + box(b"trak", box(b"tkhd", tkhd)) + title)


def test_mp4(tmp_path):
    p = tmp_path / "a.mp4"
    p.write_bytes(mp4_file())
    m = media.file_meta(str(p), "mp4")
    assert (m["original_name"], m["time"], m["additional_info"]["width"], m["additional_info"]["duration"]) == ("Clip", dt.datetime(2020, 5, 1), "640", "5.0")
    assert validate.validate_file(str(p))["details"]["brand"] == "isom"


def test_avi_tags_and_names():
    info = b"LIST" + (4 + 8 + 4 + 8 + 10).to_bytes(4, "little") + b"INFO" + b"INAM" + (4).to_bytes(4, "little") + b"Hi\0\0" + b"ICRD" + (10).to_bytes(4, "little") + b"2021-02-03"
    m = media.avi(b"RIFF" + b"\0\0\0\0" + b"AVI " + info)
    assert (m["original_name"], m["time"]) == ("Hi", dt.datetime(2021, 2, 3))
    assert media.avi(b"not an avi", "holiday-video.avi")["original_name"] == "holiday video"
    frame = lambda k, v: k + (len(v) + 1).to_bytes(4, "big") + b"\0\0\3" + v
    body = frame(b"TIT2", b"Song") + frame(b"TYER", b"1999")
    t = media.tags(b"ID3\3\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body)
    assert (t["original_name"], t["time"], t["source"]) == ("Song", dt.datetime(1999, 1, 1), "tag:Year")
    v1 = b"TAG" + b"Old".ljust(30, b"\0") + b"\0" * 60 + b"1988" + b"\0" * 31
    assert media.tags(b"\xff\xfb\x90\0", v1)["original_name"] == "Old"


@pytest.mark.parametrize("order, mark", [("<", b"II*\0"), (">", b"MM\0*")])
def test_exif(order, mark):
    p = lambda f, *x: struct.pack(order + f, *x)
    date, model = b"2024:01:15 14:30:52\0", b"Cam\0"
    ifd0 = p("H", 2) + p("HHI", 0x0110, 2, 4) + model + p("HHII", 0x8769, 4, 1, 38) + p("I", 0)
    exif = p("H", 1) + p("HHII", 0x9003, 2, 20, 56) + p("I", 0)
    block = mark + p("I", 8) + ifd0 + exif
    block = block.ljust(56, b"\0") + date
    jpg = b"\xff\xd8\xff\xe1" + (len(block) + 8).to_bytes(2, "big") + b"Exif\0\0" + block + b"\xff\xc0\0\x11\x08\0\x10\0\x20" + b"\0" * 10 + b"\xff\xd9"
    i = media.image(jpg)
    assert (i["Exif"]["camera_model"], i["time"], i["Width"], i["Height"]) == ("Cam", dt.datetime(2024, 1, 15, 14, 30, 52), 32, 16)
    assert media.image(b"\xff\xd8\xff\xd9") is None and media.image(b"\xff\xd8\xff\xd9", True)["HasExif"] is False


def riff(kind: bytes, body: bytes) -> bytes:
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + kind + body


def chunk(tag: bytes, body: bytes, order="little") -> bytes:
    return tag + len(body).to_bytes(4, order) + body + b"\0" * (len(body) % 2)


FILES = {
    "a.png": b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">IIBBBBB", 3, 2, 8, 6, 0, 0, 0) + b"\0" * 4 + b"\0\0\0\0IEND\xae\x42\x60\x82",
    "a.gif": b"GIF89a" + struct.pack("<HH", 4, 5) + b"\0\0\0" + b";",
    "a.bmp": b"BM" + (26).to_bytes(4, "little") + b"\0" * 12 + struct.pack("<ii", 7, -8),
    "a.webp": riff(b"WEBP", b"VP8X" + b"\x0a\0\0\0" + b"\0" * 4 + b"\x01\0\0\x02\0\0"),
    "a.jpg": b"\xff\xd8\xff\xc0\0\x11\x08\0\x10\0\x20" + b"\0" * 10 + b"\xff\xd9",
    "a.mp4": mp4_file(),
    "a.mkv": mkv_file(),
    "a.avi": riff(b"AVI ", chunk(b"LIST", b"hdrl") + chunk(b"LIST", b"movi")),
    "a.wmv": bytes.fromhex("3026B2758E66CF11A6D900AA0062CE6C") + (30).to_bytes(8, "little") + b"\0" * 6,
    "a.flv": b"FLV\x01\x05\0\0\0\x09",
    "a.mp3": b"\xff\xfb\x90\0" + b"\0" * 20,
    "a.flac": b"fLaC\x80\0\0\x22" + b"\0" * 10 + (44100 << 44 | 1 << 41 | 15 << 36).to_bytes(8, "big") + b"\0" * 16,
    "a.wav": riff(b"WAVE", chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)) + chunk(b"data", b"\0\0")),
    "a.ogg": b"OggS\0\x02" + b"\0" * 20 + b"\x01\x02ab" + b"OggS\0\x04" + b"\0" * 20 + b"\0",
    "a.aiff": b"FORM" + (4 + 8 + 8 + 8 + 2).to_bytes(4, "big") + b"AIFF" + chunk(b"COMM", struct.pack(">HIH", 1, 0, 16), "big") + chunk(b"SSND", b"\0\0", "big"),
}


@pytest.mark.parametrize("name", list(FILES))
def test_valid_and_truncated(tmp_path, name):
    p = tmp_path / name
    p.write_bytes(FILES[name])
    row = validate.validate_file(str(p))
    assert row["valid"], row
    p.write_bytes(FILES[name][: 3 if name != "a.bmp" else 20])
    row = validate.validate_file(str(p))
    assert not row["valid"] and row["error"]["type"] in ("truncated", "invalid_header", "corrupted")


def test_validator_edges(tmp_path):
    assert validate.error_text("corrupted", "bad data", 12) == "corrupted at byte 12: bad data"
    (tmp_path / "e.jpg").write_bytes(b"")
    (tmp_path / "x.custom").write_bytes(b"data")
    (tmp_path / "loop.mp4").write_bytes(box(b"ftyp", b"isom") + b"\0\0\0\1moov" + b"\0" * 8)
    get = lambda n: validate.validate_file(str(tmp_path / n))
    assert get("e.jpg")["error"]["type"] == "empty"
    assert get("x.custom")["valid"] and get("x.custom")["file_type"] == "unknown"
    assert get("loop.mp4")["error"]["type"] == "corrupted"
    assert get("gone.jpg")["error"]["type"] == "access_error"
    assert validate.for_mime("image/png") is not None and validate.for_extension(".nope") is None
    for k in range(4, 12):
        assert media.avi(b"RIFF1234AVI "[:k]) is not None
