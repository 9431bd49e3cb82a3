"""Small scalar rules: durations, time patterns, rounding, paths, digests."""

from __future__ import annotations

import hashlib
import math
import re
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = {"d": 86400, "h": 3600, "t": 60, "min": 60, "m": 60, "s": 1, "sec": 1, "ms": 1e-3, "us": 1e-6}
#: strptime directives and what Spark's patterns call them. Fixed values.
_PATTERN = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "XX", "Z": "z", "%": "%"}


def seconds_of(text: str) -> float:
    """Seconds of a duration such as 12H, 90min or 1.5h."""
    found = re.fullmatch(r"\s*([0-9.]+)\s*([A-Za-z]+)\s*", text)
    if not found or found[2].lower() not in _SECONDS:
        raise ValueError(f"not a duration: {text!r}")
    return float(found[1]) * _SECONDS[found[2].lower()]


def spark_pattern(strptime: str) -> str:
    """A strptime format as a Spark datetime pattern."""

    def one(m: re.Match) -> str:
        if m[1] is None:
            return f"'{m[0]}'"
        if m[1] not in _PATTERN:
            raise ValueError(f"no pattern for %{m[1]}")
        return _PATTERN[m[1]]

    return re.sub(r"%(.)|[A-Za-z]+", one, strptime)


def whole(c: Column) -> Column:
    """Rounded half to even, as a long; NULL stays."""
    return F.bround(c).cast("long")


def nan_int(x: float | None) -> int | None:
    """Toward zero; nothing for NaN."""
    return None if x is None or math.isnan(x) else int(x)


def clock(seconds: Column) -> Column:
    """HH:MM:SS of seconds since midnight, cut to whole seconds."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "HH:mm:ss")


def resolve_path(path: str) -> tuple[str, str, str]:
    """(folder, name, extension): the first suffix is the extension; a name without one raises IndexError."""
    p = PurePosixPath(path)
    suffix = p.suffixes[0]
    return str(p.parent), p.name.split(suffix)[0], suffix


def path_parts(path: Column) -> dict[str, Column]:
    """resolve_path() of a column of paths that have a folder; all parts but the folder are NULL for a name without a suffix."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    suffix = F.nullif(F.regexp_extract(name, r"^[^.]+(\.[^.]+)", 1), F.lit(""))
    return {"folder": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "name": F.when(suffix.isNotNull(), F.substring_index(name, ".", 1)), "extension": suffix}


def md5_of(path: str) -> str:
    found = hashlib.md5()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 12), b""):
            found.update(block)
    return found.hexdigest()
