"""File types from content: text patterns as columns, signatures and both stages over bytes."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD, PATTERN_HEAD = 512, 64 << 10
OTHER = "other extension"


def pattern_type(text: Column, with_json: Column | None = None) -> Column:
    """The class of a text; with_json: a boolean column from is_json(), as that test needs a parser."""
    t = F.regexp_replace(text, r"^[\s\u0085  -     　 ]+", "")
    low = F.lower(t)
    has = lambda *xs: _all([F.contains(text, F.lit(x)) for x in xs])
    ini = has("[", "]", "=")
    rules = [
        ("php", t.startswith("<?php")),
        ("xml", low.startswith("<?xml")),
        ("html", low.startswith("<!doctype html>") | low.startswith("<html")),
        ("go", t.startswith("package ") & has("type ", "func ", "import ")),
        ("python", t.startswith("#!/usr/bin/python") | has("def ", ":")),
        ("json", F.lit(False) if with_json is None else with_json),
        ("md", t.startswith("# ") | F.contains(text, F.lit("\n#"))),
        ("js", has("function", "{") | has("=> ")),
        ("ts", has("interface", "type ") | has("export ")),
        ("css", has("{", "}") & (has("color") | has("background") | has("font"))),
        ("ini", ini),
        ("toml", ini & has('"')),
        ("latex", t.startswith("\\documentclass")),
    ]
    out = F.lit(OTHER)
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").when(F.contains(text, F.lit("\0")), "binary").otherwise(out)


def _all(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


def is_json_text(data: bytes | str) -> bool:
    try:
        json.loads(data, parse_constant=_refuse)
        return True
    except (ValueError, RecursionError):
        return False


def _refuse(name: str):
    raise ValueError(name)


def pattern_bytes(data: bytes) -> str:
    """The same chain over bytes, with the JSON test."""
    if not data:
        return "empty"
    if b"\0" in data:
        return "binary"
    text = data.decode("utf-8", "replace")
    t = text.lstrip()
    low = t.lower()
    has = lambda *xs: all(x in text for x in xs)
    rules = (
        ("php", lambda: t.startswith("<?php")),
        ("xml", lambda: low.startswith("<?xml")),
        ("html", lambda: low.startswith(("<!doctype html>", "<html"))),
        ("go", lambda: t.startswith("package ") and has("type ", "func ", "import ")),
        ("python", lambda: t.startswith("#!/usr/bin/python") or has("def ", ":")),
        ("json", lambda: is_json_text(data)),
        ("md", lambda: t.startswith("# ") or has("\n#")),
        ("js", lambda: has("function", "{") or has("=> ")),
        ("ts", lambda: has("interface", "type ") or has("export ")),
        ("css", lambda: has("{", "}") and (has("color") or has("background") or has("font"))),
        ("ini", lambda: has("[", "]", "=")),
        ("latex", lambda: t.startswith("\\documentclass")),
    )
    return next((name for name, rule in rules if rule()), OTHER)


# Public magic numbers as (type, [(offset, hex)]); the first that fits counts.
PUBLIC = [
    ("jpg", [(0, "FFD8FF")]), ("png", [(0, "89504E470D0A1A0A")]), ("gif", [(0, "474946383761")]), ("gif", [(0, "474946383961")]),
    ("webp", [(0, "52494646"), (8, "57454250")]), ("cr2", [(0, "49492A00"), (8, "4352")]), ("tif", [(0, "49492A00")]), ("tif", [(0, "4D4D002A")]),
    ("bmp", [(0, "424D")]), ("jxr", [(0, "4949BC")]), ("psd", [(0, "38425053")]), ("ico", [(0, "00000100")]), ("dwg", [(0, "41433130")]),
    ("m4v", [(4, "667479704D3456")]), ("heic", [(4, "6674797068656963")]), ("m4a", [(4, "667479704D3441")]), ("mov", [(4, "6674797071742020")]), ("3gp", [(4, "66747970336770")]), ("mp4", [(4, "66747970")]),
    ("webm", [(0, "1A45DFA3"), (31, "7765626D")]), ("mkv", [(0, "1A45DFA3")]), ("avi", [(0, "52494646"), (8, "415649")]), ("wmv", [(0, "3026B2758E66CF11A6D9")]), ("mpg", [(0, "000001BA")]), ("mpg", [(0, "000001B3")]), ("flv", [(0, "464C5601")]),
    ("mid", [(0, "4D546864")]), ("mp3", [(0, "494433")]), ("mp3", [(0, "FFFB")]), ("ogg", [(0, "4F676753")]), ("flac", [(0, "664C6143")]), ("wav", [(0, "52494646"), (8, "57415645")]), ("amr", [(0, "2321414D520A")]), ("aac", [(0, "FFF1")]), ("aac", [(0, "FFF9")]), ("aiff", [(0, "464F524D"), (8, "41494646")]),
    ("epub", [(0, "504B0304"), (30, "6D696D65747970656170706C69636174696F6E2F657075622B7A6970")]), ("zip", [(0, "504B0304")]), ("zip", [(0, "504B0506")]), ("tar", [(257, "7573746172")]), ("rar", [(0, "526172211A07")]), ("gz", [(0, "1F8B08")]), ("bz2", [(0, "425A68")]), ("7z", [(0, "377ABCAF271C")]), ("xz", [(0, "FD377A585A00")]), ("zst", [(0, "28B52FFD")]),
    ("pdf", [(0, "25504446")]), ("exe", [(0, "4D5A")]), ("swf", [(0, "435753")]), ("swf", [(0, "465753")]), ("rtf", [(0, "7B5C727466")]), ("ps", [(0, "25215053")]), ("sqlite", [(0, "53514C69")]), ("deb", [(0, "213C617263683E0A64656269616E")]), ("lz", [(0, "4C5A4950")]), ("rpm", [(0, "EDABEEDB")]), ("elf", [(0, "7F454C46")]), ("dcm", [(128, "4449434D")]), ("iso", [(32769, "4344303031")]), ("crx", [(0, "43723234")]), ("cab", [(0, "4D534346")]),
    ("wasm", [(0, "0061736D01000000")]), ("woff", [(0, "774F4646")]), ("woff2", [(0, "774F4632")]), ("ttf", [(0, "0001000000")]), ("otf", [(0, "4F54544F00")]), ("doc", [(0, "D0CF11E0A1B11AE1")]),
]
# Further signatures in order of registration; they come after the public ones.
CUSTOM = [
    ("jar", [(0, "504B0304")]), ("class", [(0, "CAFEBABE")]), ("pyc", [(0, "420D0D0A")]), ("wma", [(0, "3026B2758E66CF11A6D900AA0062CE6C")]), ("jp2", [(0, "0000000C6A502020")]), ("pcx", [(0, "0A050108")]),
    ("ai", [(0, "255044462D41")]), ("eps", [(0, "252150532D")]), ("indd", [(0, "0606EDF5D81D46E5")]), ("prproj", [(0, "505250A4")]), ("xcf", [(0, "67696D7020786366")]), ("fbx", [(0, "4B6179646172615820373030303030")]), ("fbx", [(0, "4B61796461726120464258")]),
    ("fla", [(0, "504B0304")]), ("swc", [(0, "504B0304")]), ("mdb", [(0, "00010000")]), ("accdb", [(0, "504B0304")]), ("pfx", [(0, "3082")]), ("dsa", [(0, "3081")]), ("ani", [(0, "52494646"), (8, "41434F4E")]),
    ("lnk", [(0, "4C0000000114020000000000C000000000000046")]), ("html", [(0, "3C21444F43545950")]), ("sh", [(0, "23212F7573722F62696E2F7368")]), ("plist", [(0, "3C3F706C6973")]), ("plist", [(0, "62706C697374")]), ("torrent", [(0, "64383A616E6E6F756E6365")]), ("hdr", [(0, "233F52414449414E4345")]), ("nef", [(0, "49492A00")]),
    ("ds_store", [(0, "0000000142756431")]), ("icm", [(0, "48434D53")]), ("php", [(0, "3C3F706870")]), ("m3u", [(0, "234558544D3355")]), ("au", [(0, "2E736E64")]), ("pl", [(0, "23212F7573722F62696E2F7065726C")]), ("bash", [(0, "23212F62696E2F62617368")]), ("wv", [(0, "7776706B")]), ("blend", [(0, "424C454E444552")]), ("cdr", [(0, "52494646"), (8, "43445244")]),
    ("one", [(0, "E4525C7B8CD8A74DAEB237A912568E98")]), ("mbox", [(0, "46726F6D20202020")]), ("mbox", [(0, "46726F6D20")]), ("vcf", [(0, "424547494E3A5643415244")]),
]


def signatures(custom: bool = True, custom_first: bool = False) -> list[tuple[str, list[tuple[int, str]]]]:
    more = CUSTOM if custom else []
    return [*more, *PUBLIC] if custom_first else [*PUBLIC, *more]


def magic_type(head: bytes, custom: bool = True, custom_first: bool = False) -> str | None:
    for name, parts in signatures(custom, custom_first):
        if all(head[at : at + len(h) // 2] == bytes.fromhex(h) for at, h in parts):
            return name
    if custom and head[:2] == b"MZ" and (len(head) < 64 or head[int.from_bytes(head[60:64], "little") :][:4] == b"PE\0\0"):
        return "dll"
    return None


def magic_column(head: Column, custom: bool = True) -> Column:
    """magic_type() over a binary column; null where nothing fits."""
    out = F.lit(None).cast("string")
    for name, parts in reversed(signatures(custom)):
        out = F.when(_all([F.substring(head, at + 1, len(h) // 2) == F.unhex(F.lit(h)) for at, h in parts]), name).otherwise(out)
    return out


def detect_bytes(name: str, head: bytes, size: int | None = None, custom: bool = True) -> str:
    """Both stages over the first 64 KiB (or all) of a file."""
    ext = re.search(r"\.([^.]*)$", name.rsplit("/", 1)[-1])
    ext = ext[1] if ext else ""
    first = head[:HEAD]
    if not first:
        found = ext or "empty"
    else:
        found = magic_type(first, custom) or ext or pattern_bytes(first)
    if found == "empty":
        return "unknown"
    if found != OTHER:
        return found
    found = pattern_bytes(head[:PATTERN_HEAD])
    if found not in (OTHER, "empty"):
        return found
    if head.lstrip()[:1] in b'{["-0123456789tfn' and head.strip() and is_json_text(head):
        return "json"
    return "unknown"
