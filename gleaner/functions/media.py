"""Dates, titles and facts from the headers of media files.  Untrusted bytes: every loop advances and checks its bounds."""

from __future__ import annotations

import datetime as dt
import re
import struct

MKV_HEAD = AVI_HEAD = 512 << 10
MP4_EPOCH = dt.datetime(1904, 1, 1)
MKV_EPOCH = dt.datetime(2001, 1, 1)


def result(name: str | None = None, time: dt.datetime | None = None, source: str = "", **more) -> dict:
    return {"original_name": name or "", "time": time, "source": source, "valid": time is not None, "additional_info": {k: str(v) for k, v in more.items() if v not in (None, "")}}


def parse_time(text: str | None, *formats: str) -> dt.datetime | None:
    for f in formats:
        try:
            return dt.datetime.strptime((text or "").strip(), f)
        except ValueError:
            pass
    return None


# ---- EXIF -------------------------------------------------------------------------------

# Sizes of TIFF field types, and the tags that are read.
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
TAGS = {0x0110: "model", 0x0132: "modified", 0x8769: "exif", 0x8825: "gps", 0x9003: "original", 0x9004: "created", 0x0100: "width", 0x0101: "height", 0xA002: "width", 0xA003: "height"}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}


def tiff(data: bytes) -> dict:
    """Wanted tags of a TIFF block, in either byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        return {}
    out, seen = {}, set()

    def walk(at: int, names: dict) -> None:
        if at in seen or at + 2 > len(data) or len(seen) > 16:
            return
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        for k in range(n):
            e = at + 2 + 12 * k
            if e + 12 > len(data):
                return
            tag, kind, count = struct.unpack_from(order + "HHI", data, e)
            size = TIFF_SIZES.get(kind, 0) * count
            if tag not in names or not size or size > 1 << 16:
                continue
            where = e + 8 if size <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
            raw = data[where : where + size]
            if len(raw) < size:
                continue
            if kind == 2:
                value = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
            elif kind in (5, 10):
                nums = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
                value = [a / b if b else 0.0 for a, b in zip(nums[::2], nums[1::2])]
            else:
                value = struct.unpack(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * count, raw)[0]
            name = names[tag]
            if name in ("exif", "gps"):
                walk(int(value), TAGS if name == "exif" else GPS)
            else:
                out.setdefault(name, value)

    walk(struct.unpack_from(order + "I", data, 4)[0], TAGS)
    return out


def jpeg_facts(data: bytes) -> tuple[bytes, int, int]:
    """The EXIF block of a JPEG, width, height."""
    at, exif, w, h = 2, b"", 0, 0
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark in (0xD9, 0xDA):
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2:
            break
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE1 and body[:6] == b"Exif\0\0" and not exif:
            exif = body[6:]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            h, w = struct.unpack_from(">HH", body, 1)
        at += 2 + size
    return exif, w, h


def image_size(data: bytes) -> tuple[int, int]:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack_from(">II", data, 16)
    if data[:3] == b"GIF" and len(data) >= 10:
        return struct.unpack_from("<HH", data, 6)
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack_from("<ii", data, 18)
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        return jpeg_facts(data)[1:]
    return 0, 0


def degrees(value, ref: str) -> float | None:
    if not isinstance(value, list) or len(value) < 3:
        return None
    d = value[0] + value[1] / 60 + value[2] / 3600
    return -d if ref in ("S", "W") else d


def image(data: bytes, without_exif: bool = False) -> dict | None:
    """Image facts as in the image_exif struct, with `time` and `source` besides; null without EXIF unless asked for."""
    block = jpeg_facts(data)[0] if data[:2] == b"\xff\xd8" else data if data[:2] in (b"II", b"MM") else b""
    at = data.find(b"Exif\0\0") if not block and data[:4] in (b"RIFF", b"\x89PNG") else -1
    t = tiff(block or (data[at + 6 :] if at >= 0 else b""))
    if not t and not without_exif:
        return None
    w, h = image_size(data)
    when, source = None, ""
    for key, name in (("original", "exif:DateTimeOriginal"), ("created", "exif:CreateDate"), ("modified", "exif:ModifyDate")):
        if when is None and (found := parse_time(str(t.get(key, "")), "%Y:%m:%d %H:%M:%S")):
            when, source = found, name
    exif = {"date_taken": t.get("original"), "camera_model": t.get("model"), "lat": degrees(t.get("lat"), t.get("lat_ref", "N")), "lon": degrees(t.get("lon"), t.get("lon_ref", "E"))}
    return {"Width": w or t.get("width", 0), "Height": h or t.get("height", 0), "HasExif": bool(t), "Exif": exif if t else None, "time": when, "source": source}


# ---- Matroska ---------------------------------------------------------------------------


def ebml_id(data: bytes) -> tuple[int, int]:
    """An element's identifier with its marker, and its length."""
    if not data or not data[0]:
        return 0, 0
    n = 9 - data[0].bit_length()
    return (int.from_bytes(data[:n], "big"), n) if n <= 4 and len(data) >= n else (0, 0)


def ebml_size(data: bytes) -> tuple[int, int]:
    """An element's size without its marker, and the length of the number."""
    if not data or not data[0]:
        return 0, 0
    n = 9 - data[0].bit_length()
    return (int.from_bytes(data[:n], "big") & (1 << 7 * n) - 1, n) if len(data) >= n else (0, 0)


def elements(data: bytes):
    """(identifier, body) of each element; one of unknown or excessive size reaches to the end."""
    at = 0
    while at < len(data):
        ident, a = ebml_id(data[at : at + 4])
        size, b = ebml_size(data[at + a : at + a + 8])
        if not a or not b:
            return
        body = at + a + b
        end = len(data) if size == (1 << 7 * b) - 1 else min(len(data), body + size)
        yield ident, data[body:end]
        at = max(end, body)


def text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("utf-8", "replace").strip()


def name_title(name: str, ignore: str) -> str:
    base = re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1])
    base = re.sub(r"[_.\-\s]+", " ", base).strip()
    return "" if re.match(ignore, base, re.I) else base


def mkv(head: bytes, name: str = "") -> dict:
    title, when = "", None
    for ident, body in elements(head[:MKV_HEAD]):
        if ident != 0x18538067:
            continue
        for part, inner in elements(body):
            if part == 0x1549A966:
                for k, v in elements(inner):
                    if k == 0x7BA9:
                        title = title or text(v)
                    elif k == 0x4461 and len(v) == 8:
                        try:
                            when = MKV_EPOCH + dt.timedelta(microseconds=int.from_bytes(v, "big", signed=True) // 1000)
                        except OverflowError:
                            pass
            elif part == 0x1254C367 and not title:
                for _, tag in elements(inner):
                    for k, simple in elements(tag):
                        if k == 0x67C8:
                            f = dict(elements(simple))
                            if text(f.get(0x45A3, b"")).upper() == "TITLE":
                                title = title or text(f.get(0x4487, b""))
    source = "mkv:DateUTC" if when else "mkv:Title" if title else ""
    if not title and len((t := name_title(name, r"recup")).encode()) > 2:
        title, source = t, source or "filename"
    return result(title, when, source)


# ---- MP4 --------------------------------------------------------------------------------


def boxes(f, start: int, end: int):
    """(type, body start, body end) of the boxes in a stretch of a file."""
    while start + 8 <= end:
        f.seek(start)
        head = f.read(16)
        if len(head) < 8:
            return
        size, kind, skip = int.from_bytes(head[:4], "big"), head[4:8], 8
        if size == 1:
            size, skip = int.from_bytes(head[8:16], "big"), 16
        elif size == 0:
            size = end - start
        if size < skip or start + size > end:
            return
        yield kind, start + skip, start + size
        start += size


def mp4(f, size: int) -> dict:
    """Of an open file: duration, creation date, dimensions, title."""
    facts: dict = {}

    def walk(a: int, b: int, depth: int) -> None:
        for kind, start, end in boxes(f, a, b):
            if kind in (b"moov", b"trak", b"udta", b"ilst", b"\xa9nam") and depth < 8 or kind == b"meta":
                f.seek(start)
                if kind == b"\xa9nam" and (raw := f.read(min(end - start, 1024)))[4:8] != b"data":
                    n = int.from_bytes(raw[:2], "big")
                    facts.setdefault("title", text(raw[4 : 4 + n]))
                walk(start + 4 * (kind == b"meta"), end, depth + 1)
            elif kind == b"data":
                f.seek(start + 8)
                facts.setdefault("title", text(f.read(min(end - start - 8, 1024))))
            elif kind == b"mvhd":
                f.seek(start)
                raw = f.read(32)
                try:
                    if raw[0] == 1:
                        made, _, scale, length = struct.unpack_from(">QQIQ", raw, 4)
                    else:
                        made, _, scale, length = struct.unpack_from(">IIII", raw, 4)
                    facts["duration"] = length / scale if scale else None
                    when = MP4_EPOCH + dt.timedelta(seconds=made)
                    facts["time"] = when if when.year > 1990 else None
                except (struct.error, OverflowError, IndexError):
                    pass
            elif kind == b"tkhd":
                f.seek(start)
                raw = f.read(96)
                at = (88 if raw[:1] == b"\1" else 76)
                if len(raw) >= at + 8:
                    w, h = struct.unpack_from(">II", raw, at)
                    if w >> 16:
                        facts.setdefault("width", w >> 16)
                        facts.setdefault("height", h >> 16)

    walk(0, size, 0)
    when, title = facts.get("time"), facts.get("title", "")
    return result(title, when, "mp4:CreationTime" if when else "mp4:Title" if title else "", duration=facts.get("duration"), width=facts.get("width"), height=facts.get("height"))


# ---- AVI and audio tags -----------------------------------------------------------------

AVI_DATES = ("%Y-%m-%d", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%a %b %d %H:%M:%S %Y", "%Y", "%d/%m/%Y")


def avi(head: bytes, name: str = "") -> dict:
    facts: dict[bytes, str] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            kind, size = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
            body, stop = at + 8, min(end, at + 8 + size)
            if kind == b"LIST" and head[body : body + 4] == b"INFO":
                walk(body + 4, stop)
            elif kind in (b"INAM", b"IART", b"ICRD", b"ICMT", b"IPRD"):
                facts.setdefault(kind, text(head[body:stop]))
            at = body + size + size % 2

    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        walk(12, min(len(head), AVI_HEAD))
    title, when = facts.get(b"INAM", ""), parse_time(facts.get(b"ICRD"), *AVI_DATES)
    source = "avi:ICRD" if when else "avi:INAM" if title else ""
    if not title and (t := name_title(name, r"recup dir|\d+$")):
        title, source = t, source or "filename"
    return result(title, when, source, artist=facts.get(b"IART"), comment=facts.get(b"ICMT"), product=facts.get(b"IPRD"))


def tags(head: bytes, tail: bytes = b"") -> dict:
    """ID3v2, ID3v1 or Vorbis comments: title, year, artist, album, genre."""
    t: dict[str, str] = {}
    kind = ""
    if head[:3] == b"ID3" and len(head) >= 10:
        kind, version = "ID3v2", head[3]
        end, at = 10 + sum(b << s for b, s in zip(head[6:10], (21, 14, 7, 0))), 10
        names = {b"TIT2": "title", b"TYER": "year", b"TDRC": "year", b"TPE1": "artist", b"TALB": "album", b"TCON": "genre", b"TT2": "title", b"TYE": "year", b"TP1": "artist", b"TAL": "album", b"TCO": "genre"}
        wide = 3 if version == 2 else 4
        while at + 2 * wide + 2 <= min(end, len(head)) and head[at]:
            ident, raw = head[at : at + wide], head[at + wide : at + 2 * wide]
            size = sum((b & 127) << 7 * k for k, b in enumerate(reversed(raw))) if version == 4 else int.from_bytes(raw, "big")
            body = head[at + (6 if version == 2 else 10) :][:size]
            if ident in names and body:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                t.setdefault(names[ident], body[1:].decode(code, "replace").split("\0")[0].strip())
            at += (6 if version == 2 else 10) + size
    elif (at := max(head.find(b"\x03vorbis"), -1)) >= 0 or head[:4] == b"fLaC":
        kind, body = "VORBIS", head[at + 7 :]
        if at < 0:
            at = 4
            while at + 4 <= len(head) and head[at] & 127 != 4:
                at += 4 + int.from_bytes(head[at + 1 : at + 4], "big")
            body = head[at + 4 :]
        try:
            n = struct.unpack_from("<I", body)[0]
            count, at = struct.unpack_from("<I", body, 4 + n)[0], 8 + n
            for _ in range(min(count, 1000)):
                n = struct.unpack_from("<I", body, at)[0]
                k, _, v = body[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
                t.setdefault({"date": "year"}.get(k.lower(), k.lower()), v)
                at += 4 + n
        except struct.error:
            pass
    elif tail[-128:-125] == b"TAG":
        kind, raw = "ID3v1", tail[-128:]
        t = {k: raw[a:b].split(b"\0")[0].decode("latin-1").strip() for k, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97))}
    y = re.match(r"\d{4}", t.get("year", ""))
    when = dt.datetime(int(y[0]), 1, 1) if y and int(y[0]) > 0 else None
    return result(t.get("title"), when, "tag:Year" if when else "tag:Title" if t.get("title") else "", artist=t.get("artist"), album=t.get("album"), genre=t.get("genre"), filetype=kind)


def file_meta(path: str, kind: str) -> dict:
    """By type: which parser reads what part of the file; empty for other types and unreadable files."""
    from .paths import AUDIO_TYPES, IMAGE_TYPES

    try:
        with open(path, "rb") as f:
            if kind in IMAGE_TYPES:
                i = image(f.read(256 << 10)) or {}
                return result("", i.get("time"), i.get("source", ""))
            if kind in ("mkv", "webm"):
                return mkv(f.read(MKV_HEAD), path)
            if kind in ("avi", "divx"):
                return avi(f.read(AVI_HEAD), path)
            if kind in ("mp4", "m4v", "m4a", "mov"):
                return mp4(f, f.seek(0, 2))
            if kind in AUDIO_TYPES:
                head = f.read(512 << 10)
                f.seek(max(0, f.seek(0, 2) - 128))
                return tags(head, f.read(128))
    except (OSError, ValueError):
        pass
    return result()
