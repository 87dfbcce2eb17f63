"""Scalar expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pointer_token(key: Column) -> Column:
    """A key as a JSON Pointer segment."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def format_bytes(n: Column) -> Column:
    """Bytes in units of 1024 with two decimals, ties to even; below 1024 as whole bytes."""
    out = F.when(n < 1024, F.format_string("%d B", n))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.2f {unit}", F.bround(n / float(1024**power), 2)))
    return out.otherwise(F.format_string("%.2f PiB", F.bround(n / float(1024**5), 2)))


def format_duration(ms: Column) -> Column:
    """Milliseconds below a second as such, else seconds with two decimals."""
    return F.when(ms < 1000, F.format_string("%dms", ms)).otherwise(F.format_string("%.2fs", F.bround(ms / 1000.0, 2)))


def rewrite_prefix(path: Column, prefixes: dict[str, str]) -> Column:
    """A path with its first matching folder prefix replaced."""
    out = None
    for old, new in prefixes.items():
        hit = path.startswith(old + "/")
        value = F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return path if out is None else out.otherwise(path)


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))
