"""Options and their spellings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum


class _Spelled(Enum):
    @classmethod
    def parse(cls, text: str):
        """The member spelled so; the class's default (or an error, if it has none) for unknown spellings."""
        found = SPELLINGS[cls].get((text or "").strip().lower())
        if found is not None:
            return cls(found)
        default = DEFAULTS.get(cls)
        if default is None:
            raise ValueError(f"unknown {cls.__name__}: {text!r}")
        return cls(default)

    def __str__(self) -> str:
        return self.value


class Action(_Spelled):
    DELETE, HARDLINK, SYMLINK, DRY_RUN = "delete", "hardlink", "symlink", "dry-run"


class Keep(_Spelled):
    FIRST, SHORTEST, OLDEST, NEWEST, BY_PATH = "first", "shortest", "oldest", "newest", "path"


class Conflict(_Spelled):
    INCREMENT, HASH, TIMESTAMP, SKIP, OVERWRITE = "increment", "hash", "timestamp", "skip", "overwrite"


class DateLayout(_Spelled):
    NONE, YEAR, YEAR_MONTH, YEAR_MONTH_DAY = "none", "year", "year-month", "year-month-day"


class DateSource(_Spelled):
    AUTO, METADATA, FILESYSTEM = "auto", "metadata", "filesystem"


class Mode(_Spelled):
    COPY, MOVE, HARDLINK, SYMLINK = "copy", "move", "hardlink", "symlink"


class Overwrite(_Spelled):
    SKIP, OVERWRITE, RENAME = "skip", "overwrite", "rename"


def _own(cls, **more) -> dict[str, str]:
    return {m.value: m.value for m in cls} | {k: v for v, ks in more.items() for k in ks}


# Accepted spellings, and what unknown ones mean.
SPELLINGS = {
    Action: _own(Action) | {"del": "delete", "rm": "delete", "hard": "hardlink", "link": "hardlink", "sym": "symlink", "soft": "symlink", "dryrun": "dry-run", "dry": "dry-run", "n": "dry-run"},
    Keep: _own(Keep) | {"short": "shortest", "old": "oldest", "new": "newest"},
    Conflict: _own(Conflict) | {"inc": "increment", "number": "increment", "ignore": "skip", "replace": "overwrite", "time": "timestamp"},
    DateLayout: _own(DateLayout) | {"off": "none", "": "none", "y": "year", "yyyy": "year", "ym": "year-month", "yearmonth": "year-month", "yyyy/mm": "year-month", "ymd": "year-month-day", "yyyy/mm/dd": "year-month-day"},
    DateSource: _own(DateSource) | {"fs": "filesystem", "meta": "metadata"},
    Mode: _own(Mode),
    Overwrite: _own(Overwrite),
}
DEFAULTS = {Action: "dry-run", Keep: "shortest", Conflict: "increment", DateLayout: "year-month", DateSource: "auto"}


@dataclass
class OrganizeOptions:
    layout: DateLayout = DateLayout.NONE
    source: DateSource = DateSource.AUTO
    unknown: str = "unknown_date"
    with_category: bool = True


@dataclass
class ScanOptions:
    hash: bool = False
    full_hash: bool = False
    validate: str = ""
    organize: OrganizeOptions = field(default_factory=OrganizeOptions)
    normalize_ext: bool = False
    image_without_exif: bool = False
    keep_map: bool = False


@dataclass
class MoveOptions:
    source_root: str = ""
    dest_root: str = ""
    mode: Mode = Mode.COPY
    overwrite: Overwrite = Overwrite.SKIP
    dry_run: bool = True
    verify: bool = False
    skip_corrupted: bool = True
    skip_small: int = 0
    exclude: list[str] = field(default_factory=list)
    only: list[str] = field(default_factory=list)
    append_basename: bool = True
    workers: int = 4


@dataclass
class DedupOptions:
    action: Action = Action.DRY_RUN
    keep: Keep = Keep.FIRST
    priority: list[str] = field(default_factory=list)
    dry_run: bool = True
    min_size: int = 1 << 20


def workers(n: int, most: int = 32) -> int:
    return max(1, min(most, n))


def size_of(text: str | int) -> int:
    """Bytes of `5MB`, `10 k` or plain digits."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?\s*", str(text), re.I)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** " kmgt".index(m[2].lower() or " "))
