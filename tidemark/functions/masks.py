"""Masking of personal data, as columns; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_ends(value: Column, prefix: int, suffix: int, char: str = "*") -> Column:
    """Head and tail stay, each character between becomes ``char``; a text no longer than both stays whole."""
    length = F.char_length(value)
    tail = F.substr(value, length - suffix + 1, F.lit(suffix)) if suffix else F.lit("")
    masked = F.concat(F.substr(value, F.lit(1), F.lit(prefix)), F.repeat(F.lit(char), F.greatest(length - prefix - suffix, F.lit(0))), tail)
    return F.when(length <= prefix + suffix, value).otherwise(masked)


def digest(value: Column, algorithm: str = "sha256") -> Column:
    """Lower-case hex."""
    known = {"sha256": lambda v: F.sha2(v, 256), "sha512": lambda v: F.sha2(v, 512), "sha1": F.sha1, "md5": F.md5}
    if algorithm not in known:
        raise ValueError(f"unknown digest {algorithm!r}")
    return known[algorithm](value)


def replace(value: Column, pattern: str, replacement: str) -> Column:
    """Groups are written $1, $2."""
    return F.regexp_replace(value, pattern, replacement)
