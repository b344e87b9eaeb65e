"""Sizes, paths and categories, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category folders and the extensions that go to <folder>/<extension>.
FOLDERS = {
    "videos": "mp4 mkv avi mov wmv flv webm m4v mpg mpeg 3gp",
    "audio": "mp3 flac wav wma au wv aac ogg m4a opus aiff mid midi",
    "audio/playlists": "m3u m3u8 pls",
    "images": "jpg jpeg png gif bmp tiff tif webp svg ico jp2 pcx",
    "images/raw": "nef cr2 arw dng orf rw2",
    "design": "xcf ai eps indd cdr psd sketch fig xd",
    "images/3d": "hdr exr",
    "3d/models": "fbx blend obj stl dae 3ds max c4d ma mb",
    "ebooks": "epub mobi azw azw3 djvu fb2",
    "documents": "pdf",
    "documents/text": "doc docx txt rtf odt one md pages",
    "documents/spreadsheets": "xls xlsx csv ods numbers",
    "documents/presentations": "ppt pptx odp",
    "archives": "zip rar 7z tar gz bz2 xz jar swc cab iso dmg lz zst",
    "databases": "db sqlite sqlite3 mdb accdb sql",
    "code/web": "html htm css js jsx ts tsx vue svelte",
    "code/data": "json xml yaml yml toml",
    "code/python": "py pyc pyw",
    "code/java": "java class",
    "code/kotlin": "kt",
    "code/c": "c h",
    "code/cpp": "cpp hpp",
    "code/go": "go",
    "code/rust": "rs",
    "code/ruby": "rb",
    "code/php": "php",
    "code/perl": "pl pm",
    "code/shell": "sh bash zsh",
    "code/powershell": "ps1",
    "code/batch": "bat cmd",
    "code/swift": "swift",
    "code/scala": "scala",
    "code/r": "r",
    "code/lua": "lua",
    "code/dart": "dart",
    "code/elixir": "ex exs",
    "code/clojure": "clj",
    "code/haskell": "hs",
    "executables": "exe dll so dylib app msi deb rpm apk ipa",
    "certificates": "pfx p12 cer crt pem key dsa pub ppk",
    "system/shortcuts": "lnk",
    "system/config": "ini cfg conf plist",
    "system/registry": "reg",
    "system/macos": "ds_store",
    "fonts": "ttf otf woff woff2 eot fon",
    "contacts/email": "eml msg mbox pst ost",
    "contacts": "vcf ics",
    "ebooks/comics": "cbz cbr cbt cba cb7",
    "torrents": "torrent",
    "color-profiles": "icm icc",
    "animation": "swf fla ani",
    "audio-projects": "logic",
    "games/saves": "sav",
    "games/roms": "rom nes snes gba nds n64 gb gbc",
    "virtualization": "vmdk vdi vhd vhdx ova ovf qcow2",
    "system/windows": "sys drv ocx cpl",
    "logs": "log",
    "backups": "bak backup old orig",
}
NAMED = {"prproj": "video-projects/premiere", "aep": "video-projects/aftereffects", "veg": "video-projects/vegas", "drp": "video-projects/resolve", "fcpx": "video-projects/finalcut", "als": "audio-projects/ableton", "flp": "audio-projects/flstudio", "ptx": "audio-projects/protools", "cpr": "audio-projects/cubase"}
# Coarse kinds of the mover and of the renamer, and the types that carry metadata.
COARSE = {
    "images": "jpg jpeg png gif bmp webp tiff heic heif",
    "videos": "mp4 mkv avi mov wmv flv webm m4v mpeg mpg",
    "audio": "mp3 flac wav ogg m4a aac wma opus",
    "documents": "pdf doc docx xls xlsx ppt pptx txt rtf odt",
    "archives": "zip rar 7z tar gz bz2",
}
COARSE_RENAME = {
    "images": "jpg jpeg png gif bmp webp tiff heic heif",
    "videos": "mp4 mkv avi mov wmv flv webm",
    "audio": "mp3 flac wav ogg m4a aac",
    "documents": "pdf doc docx xls xlsx ppt pptx",
}
IMAGE_TYPES = "jpg jpeg png tiff heic heif webp gif bmp".split()
VIDEO_TYPES = "mp4 m4v mov mkv webm mka avi wmv asf flv 3gp 3g2 mpeg mpg ts".split()
AUDIO_TYPES = "mp3 flac wav wave ogg oga opus aac m4a wma aiff aif alac".split()

_registered: dict[str, str] = {}


def categories() -> dict[str, str]:
    """Extension to folder: a copy of all."""
    return {e: f"{f}/{e}" for f, es in FOLDERS.items() for e in es.split()} | NAMED | _registered


def register_category(ext: str, folder: str) -> None:
    """Adds or replaces an entry on the driver, for plans made afterwards."""
    _registered[ext] = folder


def category(ext: Column) -> Column:
    """The folder of a type (case-sensitive); `others/<type>` for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in categories().items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.concat(F.lit("others/"), ext))


def _kind(ext: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for kind, exts in reversed(table.items()):
        out = F.when(F.lower(ext).isin(exts.split()), kind).otherwise(out)
    return out


def coarse_kind(ext: Column) -> Column:
    return _kind(ext, COARSE, "other")


def coarse_kind_renamer(ext: Column) -> Column:
    return _kind(ext, COARSE_RENAME, "other")


def should_validate(ext: Column, spec: str) -> Column:
    """`all`, or a comma list of image, video, audio."""
    if spec == "all":
        return F.lit(True)
    asked = {x.strip() for x in spec.lower().split(",")}
    types = [t for k, ts in (("image", IMAGE_TYPES), ("video", VIDEO_TYPES), ("audio", AUDIO_TYPES)) if k in asked for t in ts]
    return ext.isin(types) if types else F.lit(False)


def is_media_category(path: Column) -> Column:
    return (F.octet_length(path) >= 6) & F.substring(path, 1, 6).isin("images", "videos", "audio/")


def _human(size: Column, digits: int, units: str) -> Column:
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, u in enumerate(units, 1):
        # bround: printf in Java rounds half up, the text asked for rounds half to even
        out = F.when(size >= 1024**k, F.concat(F.format_string(f"%.{digits}f", F.bround(size / float(1024**k), digits)), F.lit(f" {u}B"))).otherwise(out)
    return out


def readable_size(size: Column) -> Column:
    """Two decimals, up to TB."""
    return _human(size, 2, "KMGT")


def short_size(size: Column) -> Column:
    """One decimal, up to EB."""
    return _human(size, 1, "KMGTPE")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    at = F.octet_length(path) - F.octet_length(basename(path)) - 1
    return F.when(F.instr(path, "/") == 0, F.lit(".")).when(at == 0, F.lit("/")).otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def extension(path: Column) -> Column:
    """From the last dot of the basename, dot and all; dotfiles too."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def report_category(path: Column) -> Column:
    return F.coalesce(F.nullif(F.substring_index(path, "/", 1), F.lit("")), F.lit("Non classé"))


def plan_category(path: Column) -> Column:
    return F.coalesce(F.nullif(F.substring_index(path, "/", 2), F.lit("")), F.lit("unknown"))


def elided(path: Column, most: int) -> Column:
    """Front and end of a path longer than `most`, with dots between."""
    return F.when(F.octet_length(path) <= most, path).otherwise(F.concat(F.substring(path, 1, most // 2 - 2), F.lit("..."), F.right(path, F.lit(most // 2 - 1))))


def display_hash(h: Column) -> Column:
    return F.concat(F.substring(h, 1, 16), F.lit("..."))


def within(path: Column, folder: str) -> Column:
    """Path prefix that ends at a folder's edge."""
    folder = folder.rstrip("/") or "/"
    return (path == folder) | path.startswith(folder if folder == "/" else folder + "/")


def is_full_sha256(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("^[0-9a-fA-F]{64}$")


def percent(count: Column, total: Column) -> Column:
    return F.when(total > 0, count * 100.0 / total).otherwise(0.0)
