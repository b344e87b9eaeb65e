"""Name templates, compiled on the driver into one column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import custom_format

# Variables, presets and reserved names.
VARIABLES = "date datetime year month day hour minute second camera original ext type category hash seq size width height".split()
PRESETS = {
    "simple": "{original}.{ext}",
    "dated": "{date}_{original}.{ext}",
    "photo": "{date}_{camera}_{seq:4}.{ext}",
    "video": "{year}/{month}/{original}.{ext}",
    "hash": "{hash:8}_{original}.{ext}",
    "sequence": "{seq:6}.{ext}",
    "full": "{year}/{month}/{day}/{datetime}_{camera}_{seq:3}.{ext}",
}
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"{x}{n}" for x in ("COM", "LPT") for n in range(1, 10))]
TOKEN = re.compile(r"\{([A-Za-z_]+)(?::([^}]*))?\}")


@dataclass(frozen=True)
class Template:
    """text parts and (name, option) variables, in order."""

    source: str
    parts: tuple

    @classmethod
    def parse(cls, text: str) -> Template:
        if not text:
            raise ValueError("empty template")
        parts, at = [], 0
        for m in TOKEN.finditer(text):
            if m.start() > at:
                parts.append(text[at : m.start()])
            parts.append((m[1].lower(), m[2]))
            at = m.end()
        if at < len(text):
            parts.append(text[at:])
        t = cls(text, tuple(parts))
        t.validate()
        return t

    @classmethod
    def preset(cls, name: str) -> Template:
        return cls.parse(PRESETS[name.lower()])

    def variables(self) -> list[str]:
        return [p[0] for p in self.parts if isinstance(p, tuple)]

    def has(self, name: str) -> bool:
        return name.lower() in self.variables()

    def validate(self) -> None:
        if unknown := [v for v in self.variables() if v not in VARIABLES]:
            raise ValueError(f"unknown variables: {unknown}")

    def __str__(self) -> str:
        return self.source

    def column(self) -> Column:
        """Over columns date, camera, original, ext, type, category, hash, seq, size, width, height."""
        return F.concat(*[F.lit(p) if isinstance(p, str) else variable(*p) for p in self.parts])


def variable(name: str, option: str | None) -> Column:
    c, date = F.col, F.col("date")
    number = int(option) if option and option.isdigit() else None
    if name in ("date", "datetime"):
        given = custom_format(date, option) if option else F.date_format(date, "yyyy-MM-dd" if name == "date" else "yyyy-MM-dd_HHmmss")
        return F.coalesce(given, F.lit(f"unknown_{name}"))
    parts = {"year": ("yyyy", "unknown"), "month": ("MM", "unknown"), "day": ("dd", "unknown"), "hour": ("HH", "00"), "minute": ("mm", "00"), "second": ("ss", "00")}
    if name in parts:
        return F.coalesce(F.date_format(date, parts[name][0]), F.lit(parts[name][1]))
    blank = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), other)
    if name == "camera":
        return blank(sanitized_camera(c("camera")), F.lit("unknown_camera"))
    if name == "ext":
        return blank(F.lower("ext"), c("type"))
    if name == "category":
        return F.replace(F.coalesce("category", F.lit("")), F.lit("/"), F.lit("_"))
    if name == "hash":
        return blank(F.substring("hash", 1, number or 8), F.lit("nohash"))
    if name == "seq":
        width = number or 4
        return F.when(F.length(c("seq").cast("string")) >= width, c("seq").cast("string")).otherwise(F.lpad(c("seq").cast("string"), width, "0"))
    if name in ("size", "width", "height"):
        return F.coalesce(c(name), F.lit(0)).cast("string")
    return F.coalesce(c(name), F.lit(""))


def sanitized_camera(text: Column) -> Column:
    kept = F.regexp_replace(F.replace(text, F.lit(" "), F.lit("_")), r"[^\p{L}\p{Nd}_\-]", "")
    return F.substring(kept, 1, 30)


def sanitized(name: Column, by_segment: bool = False) -> Column:
    """A safe file name: forbidden characters, blanks, 255 bytes with the extension kept, reserved names."""
    if by_segment:
        return F.array_join(F.transform(F.split(name, "/"), lambda s: sanitized(s)), "/")
    s = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    ext = F.regexp_extract(s, r"(\.[^.]*)$", 1)
    base = F.regexp_replace(s, r"\.[^.]*$", "")
    s = F.when(F.octet_length(s) > 255, F.concat(F.substring(base, F.lit(1), 255 - F.octet_length(ext)), ext)).otherwise(s)
    return F.when(F.upper(base).isin(RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
