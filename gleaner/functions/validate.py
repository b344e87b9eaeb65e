"""Integrity checks of media files by range reads.  A check raises Bad or returns details."""

from __future__ import annotations

import os
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import VALIDATION
from .media import image_size, jpeg_facts


class Bad(Exception):
    def __init__(self, kind: str, message: str, offset: int = -1):
        self.kind, self.message, self.offset = kind, message, offset
        super().__init__(error_text(kind, message, offset))


def error_text(kind: str, message: str, offset: int = -1) -> str:
    return f"{kind} at byte {offset}: {message}" if offset >= 0 else f"{kind}: {message}"


class View:
    """A file (or bytes) of which only ranges are read."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size

    def at(self, start: int, n: int, need: bool = True) -> bytes:
        self.f.seek(max(0, start))
        out = self.f.read(n)
        if need and len(out) < n:
            raise Bad("truncated", f"{n} bytes wanted", start)
        return out

    def tail(self, n: int) -> bytes:
        return self.at(max(0, self.size - n), n, False)

    def chunks(self, at: int, end: int, big: bool = False):
        """(tag, body, size) of RIFF or IFF chunks."""
        while at + 8 <= min(end, self.size):
            head = self.at(at, 8)
            size = int.from_bytes(head[4:], "big" if big else "little")
            yield head[:4], at + 8, size
            at += 8 + size + size % 2


def declared(v: View, size: int, slack: int) -> None:
    if v.size < size - slack:
        raise Bad("truncated", f"{size} bytes declared, {v.size} there", 4)


# ---- images -----------------------------------------------------------------------------


def jpeg(v: View) -> dict:
    if b"\xff\xd9" not in v.tail(1024):
        raise Bad("truncated", "no end marker", v.size)
    _, w, h = jpeg_facts(v.at(0, min(v.size, 1 << 20), False))
    if not w or not h:
        raise Bad("decode_error", "no frame header")
    return {"width": w, "height": h, "color_model": "YCbCr"}


def png(v: View) -> dict:
    head = v.at(0, 33)
    if head[12:16] != b"IHDR":
        raise Bad("corrupted", "first chunk is not IHDR", 12)
    end = v.tail(12)
    if end[:4] != b"\0\0\0\0" or end[4:8] != b"IEND":
        raise Bad("truncated", "no IEND", v.size - 12)
    w, h = struct.unpack_from(">II", head, 16)
    return {"width": w, "height": h, "bit_depth": head[24], "color_type": head[25]}


def gif(v: View) -> dict:
    head = v.at(0, 13)
    if head[:6] not in (b"GIF87a", b"GIF89a"):
        raise Bad("invalid_header", "unknown version", 3)
    if v.tail(1) != b";":
        raise Bad("truncated", "no trailer", v.size - 1)
    w, h = struct.unpack_from("<HH", head, 6)
    return {"version": head[3:6].decode(), "width": w, "height": h}


def webp(v: View) -> dict:
    head = v.at(0, 30)
    declared(v, int.from_bytes(head[4:8], "little") + 8, 1)
    kind = head[12:16]
    if kind == b"VP8X":
        w, h = (int.from_bytes(head[k : k + 3], "little") + 1 for k in (24, 27))
    elif kind == b"VP8L" and head[20] == 0x2F:
        bits = int.from_bytes(head[21:25], "little")
        w, h = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    elif kind == b"VP8 " and head[23:26] == b"\x9d\x01\x2a":
        w, h = (x & 0x3FFF for x in struct.unpack_from("<HH", head, 26))
    else:
        raise Bad("decode_error", "no image header", 12)
    return {"webp_type": kind.decode("latin-1").strip(), "width": w, "height": h}


def bmp(v: View) -> dict:
    head = v.at(0, 26)
    declared(v, int.from_bytes(head[2:6], "little"), 0)
    w, h = image_size(head)
    return {"width": w, "height": h}


# ---- video ------------------------------------------------------------------------------


def mp4(v: View) -> dict:
    at, seen, brand = 0, set(), ""
    while at + 8 <= v.size:
        head = v.at(at, 16, False)
        size, skip = int.from_bytes(head[:4], "big"), 8
        if size == 1:
            size, skip = int.from_bytes(head[8:16], "big"), 16
        elif size == 0:
            size = v.size - at
        if size < skip:
            raise Bad("corrupted", "atom smaller than its header", at)
        if at + size > v.size:
            raise Bad("truncated", f"atom {head[4:8].decode('latin-1')} passes the end", at)
        if head[4:8] == b"ftyp":
            brand = v.at(at + skip, 4, False).decode("latin-1").strip()
        seen.add(head[4:8])
        at += size
    for need in (b"ftyp", b"moov"):
        if need not in seen:
            raise Bad("corrupted", f"no {need.decode()} atom")
    return {"brand": brand, "has_mdat": str(b"mdat" in seen).lower()}


def vint(raw: bytes) -> tuple[int | None, int]:
    """Value (None: unknown) and length of an EBML number."""
    if not raw or not raw[0]:
        raise Bad("corrupted", "not an EBML number")
    n = 9 - raw[0].bit_length()
    if len(raw) < n:
        raise Bad("truncated", "EBML number passes the end")
    x = int.from_bytes(raw[:n], "big") & (1 << 7 * n) - 1
    return None if x == (1 << 7 * n) - 1 else x, n


def mkv(v: View) -> dict:
    size, n = vint(v.at(4, 8, False))
    at = 4 + n + (size or 0)
    if size is None or at > v.size:
        raise Bad("truncated", "EBML header passes the end", 4)
    if v.at(at, 4, False) != b"\x18\x53\x80\x67":
        raise Bad("corrupted", "no Segment after the header", at)
    size, n = vint(v.at(at + 4, 8, False))
    if size is not None and at + 4 + n + size > v.size:
        raise Bad("truncated", "Segment passes the end", at)
    return {"segment_size": "unknown" if size is None else size}


def avi(v: View) -> dict:
    declared(v, int.from_bytes(v.at(4, 4), "little") + 8, 2)
    lists = {v.at(body, 4, False) for tag, body, _ in v.chunks(12, v.size) if tag == b"LIST"}
    for need in (b"hdrl", b"movi"):
        if need not in lists:
            raise Bad("corrupted", f"no {need.decode()} list")
    return {}


def asf(v: View) -> dict:
    size = int.from_bytes(v.at(16, 8), "little")
    if size > v.size:
        raise Bad("truncated", "header passes the end", 16)
    return {"header_size": size}


def flv(v: View) -> dict:
    head = v.at(0, 9)
    size = int.from_bytes(head[5:9], "big")
    if size < 9:
        raise Bad("corrupted", "header too small", 5)
    return {"version": head[3], "has_video": str(bool(head[4] & 1)).lower(), "has_audio": str(bool(head[4] & 4)).lower()}


# ---- audio ------------------------------------------------------------------------------


def mp3(v: View) -> dict:
    head, out, at = v.at(0, 10), {}, 0
    if head[:3] == b"ID3":
        size = sum((b & 127) << s for b, s in zip(head[6:], (21, 14, 7, 0)))
        at, out["id3v2_size"] = 10 + size, size
        if at > v.size:
            raise Bad("truncated", "ID3v2 tag passes the end", 10)
    raw = v.at(at, 4096, False)
    for k in range(len(raw) - 3):
        a, b, c = raw[k : k + 3]
        if a == 0xFF and b & 0xE0 == 0xE0 and b >> 3 & 3 != 1 and b >> 1 & 3 and c >> 4 not in (0, 15):
            out["first_frame_offset"] = at + k
            break
    else:
        raise Bad("corrupted", "no frame header", at)
    if v.size >= 128 and v.tail(128)[:3] == b"TAG":
        out["has_id3v1"] = "true"
    return out


def flac(v: View) -> dict:
    head = v.at(4, 4)
    if head[0] & 127 or int.from_bytes(head[1:], "big") != 34:
        raise Bad("corrupted", "no STREAMINFO first", 4)
    info = v.at(8, 34)
    packed = int.from_bytes(info[10:18], "big")
    at, blocks, last = 4, 0, False
    while not last:
        h = v.at(at, 4)
        last, size = bool(h[0] & 128), int.from_bytes(h[1:], "big")
        blocks += 1
        at += 4 + size
        if at > v.size:
            raise Bad("truncated", "metadata block passes the end", at)
    return {"sample_rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits_per_sample": (packed >> 36 & 31) + 1, "metadata_blocks": blocks}


def wav(v: View) -> dict:
    declared(v, int.from_bytes(v.at(4, 4), "little") + 8, 2)
    found, out = set(), {}
    for tag, body, size in v.chunks(12, v.size):
        found.add(tag)
        if tag == b"fmt " and size >= 16:
            fmt, channels, rate, _, _, bits = struct.unpack("<HHIIHH", v.at(body, 16))
            out = {"audio_format": fmt, "channels": channels, "sample_rate": rate, "bits_per_sample": bits}
    for need in (b"fmt ", b"data"):
        if need not in found:
            raise Bad("corrupted", f"no {need.decode().strip()} chunk")
    return out


def ogg(v: View) -> dict:
    head = v.at(0, 27)
    if head[4]:
        raise Bad("corrupted", "unknown version", 4)
    if not head[5] & 2:
        raise Bad("corrupted", "no start of stream", 5)
    if 27 + head[26] + sum(v.at(27, head[26])) > v.size:
        raise Bad("truncated", "first page passes the end", 27)
    tail = v.tail(8192)
    pages = [k for k in range(len(tail) - 5) if tail[k : k + 4] == b"OggS"]
    if not any(tail[k + 5] & 4 for k in pages):
        raise Bad("truncated", "no end of stream", v.size)
    return {}


def aiff(v: View) -> dict:
    head = v.at(0, 12)
    declared(v, int.from_bytes(head[4:8], "big") + 8, 1)
    if head[8:12] not in (b"AIFF", b"AIFC"):
        raise Bad("invalid_header", "neither AIFF nor AIFC", 8)
    found, out = set(), {}
    for tag, body, size in v.chunks(12, v.size, True):
        found.add(tag)
        if tag == b"COMM" and size >= 8:
            channels, _, bits = struct.unpack(">HIH", v.at(body, 8))
            out = {"channels": channels, "bits_per_sample": bits}
    for need in (b"COMM", b"SSND"):
        if need not in found:
            raise Bad("corrupted", f"no {need.decode()} chunk")
    return {"form": head[8:12].decode()} | out


# ---- dispatch ---------------------------------------------------------------------------

# By family: extensions, MIME types, least header, and what a header is checked by.
FAMILIES = {
    "image": ("jpg jpeg png gif webp bmp".split(), "image/jpeg image/png image/gif image/webp image/bmp image/x-ms-bmp".split(), 4, [(lambda h: h[:3] == b"\xff\xd8\xff", "jpeg", jpeg), (lambda h: h[:8] == b"\x89PNG\r\n\x1a\n", "png", png), (lambda h: h[:4] == b"GIF8", "gif", gif), (lambda h: h[:4] == b"RIFF" and h[8:12] == b"WEBP", "webp", webp), (lambda h: h[:2] == b"BM", "bmp", bmp)]),
    "video": ("mp4 m4v mov mkv webm avi wmv asf flv 3gp wma".split(), "video/mp4 video/x-m4v video/quicktime video/x-matroska video/webm video/x-msvideo video/x-ms-wmv video/x-ms-asf video/x-flv video/3gpp".split(), 8, [(lambda h: h[4:8] == b"ftyp", "mp4", mp4), (lambda h: h[:4] == b"\x1a\x45\xdf\xa3", "mkv", mkv), (lambda h: h[:4] == b"RIFF" and h[8:12] == b"AVI ", "avi", avi), (lambda h: h[:16] == bytes.fromhex("3026B2758E66CF11A6D900AA0062CE6C"), "wmv", asf), (lambda h: h[:3] == b"FLV", "flv", flv)]),
    "audio": ("mp3 flac wav wave ogg oga opus aiff aif".split(), "audio/mpeg audio/mp3 audio/flac audio/x-flac audio/wav audio/x-wav audio/ogg application/ogg audio/opus audio/aiff audio/x-aiff".split(), 4, [(lambda h: h[:4] == b"fLaC", "flac", flac), (lambda h: h[:4] == b"RIFF" and h[8:12] == b"WAVE", "wav", wav), (lambda h: h[:4] == b"OggS", "ogg", ogg), (lambda h: h[:4] == b"FORM" and h[8:12] in (b"AIFF", b"AIFC"), "aiff", aiff), (lambda h: h[:3] == b"ID3" or h[0] == 0xFF and h[1] & 0xE0 == 0xE0, "mp3", mp3)]),
}


def by_family(name: str):
    _, _, least, rules = FAMILIES[name]

    def check(v: View) -> tuple[str, dict]:
        head = v.at(0, 16, False)
        if len(head) < least:
            raise Bad("truncated", "no header", 0)
        for test, kind, rule in rules:
            if test(head):
                return kind, rule(v)
        raise Bad("invalid_header", f"no known {name} header", 0)

    return check


_EXT = {e: by_family(n) for n, f in FAMILIES.items() for e in f[0]}
_MIME = {m: by_family(n) for n, f in FAMILIES.items() for m in f[1]}


def register(check, extensions: list[str] = (), mimes: list[str] = ()) -> None:
    """check(View) -> (type, details), or raises Bad."""
    _EXT.update({e.lower().lstrip("."): check for e in extensions})
    _MIME.update({m.lower(): check for m in mimes})


def for_extension(ext: str):
    return _EXT.get(ext.lower().lstrip("."))


def for_mime(mime: str):
    return _MIME.get(mime.lower())


def validate_file(path: str) -> dict:
    """A VALIDATION row; types without a check are valid, with a note."""
    row = {"path": path, "valid": False, "error": None, "file_type": "unknown", "details": {}}
    try:
        if not os.path.exists(path):
            raise Bad("access_error", "cannot be opened")
        if os.path.isdir(path):
            raise Bad("not_a_file", "a folder")
        size = os.path.getsize(path)
        if not size:
            raise Bad("empty", "no bytes", 0)
        check = for_extension(os.path.splitext(path)[1])
        if not check:
            return row | {"valid": True, "details": {"note": "no check for this type"}}
        with open(path, "rb") as f:
            kind, details = check(View(f, size))
        return row | {"valid": True, "file_type": kind, "details": {k: str(x) for k, x in details.items()}}
    except Bad as e:
        return row | {"error": {"type": e.kind, "message": e.message, "offset": e.offset}}
    except (OSError, struct.error, IndexError) as e:
        return row | {"error": {"type": "read_error", "message": str(e)[:200], "offset": -1}}


def validate_bytes(name: str, data: bytes) -> dict:
    """As validate_file(), of bytes that lie in a table."""
    import io

    row = {"path": name, "valid": False, "error": None, "file_type": "unknown", "details": {}}
    try:
        if not data:
            raise Bad("empty", "no bytes", 0)
        check = for_extension(os.path.splitext(name)[1])
        if not check:
            return row | {"valid": True, "details": {"note": "no check for this type"}}
        kind, details = check(View(io.BytesIO(data), len(data)))
        return row | {"valid": True, "file_type": kind, "details": {k: str(x) for k, x in details.items()}}
    except Bad as e:
        return row | {"error": {"type": e.kind, "message": e.message, "offset": e.offset}}
    except (struct.error, IndexError) as e:
        return row | {"error": {"type": "read_error", "message": str(e)[:200], "offset": -1}}


def validate_column(rows: DataFrame) -> DataFrame:
    """VALIDATION rows of (path, content)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([validate_bytes(p, bytes(c or b"")) for p, c in zip(pdf["path"], pdf["content"])], columns=["path", "valid", "error", "file_type", "details"])

    return rows.select("path", "content").mapInPandas(run, VALIDATION)


def validate(files: DataFrame) -> DataFrame:
    """VALIDATION rows of a path column: one pass of range reads."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([validate_file(p) for p in pdf["path"]], columns=["path", "valid", "error", "file_type", "details"])

    return files.select("path").mapInPandas(run, VALIDATION)


def only_corrupted(rows: DataFrame) -> DataFrame:
    return rows.where("not valid")


def only_valid(rows: DataFrame) -> DataFrame:
    return rows.where("valid")


def by_error(rows: DataFrame) -> DataFrame:
    return rows.where("not valid").groupBy(F.col("error.type").alias("type")).agg(F.count("*").alias("files"), F.array_sort(F.collect_list("path")).alias("paths"))
