"""Chromosome names: keys, styles and spelling variants. All JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space cut off around names and keys.
BLANKS = " \t\n\r\x0b\x0c"


def trimmed(col: Column) -> Column:
    """col without outer white space."""
    return F.btrim(col, F.lit(BLANKS))


def rtrimmed(col: Column) -> Column:
    """col without white space at its end."""
    return F.rtrim(col, F.lit(BLANKS))


def has_prefix(name: Column) -> Column:
    """Whether the name starts with chr (any case) and goes on after it."""
    return (F.length(name) > 3) & (F.lower(F.substring(name, 1, 3)) == "chr")


def strip_prefix(name: Column) -> Column:
    return F.when(has_prefix(name), F.substring(name, 4, 1_000_000)).otherwise(name)


def normalize(name: Column) -> Column:
    """Prefix off, upper case, M as MT. Null for null."""
    bare = F.upper(strip_prefix(name))
    return F.when(bare == "M", F.lit("MT")).otherwise(bare)


def chrom_key(name: Column) -> Column:
    """The key by which delivered names of one chromosome agree: normalize() of the trimmed name."""
    return normalize(trimmed(name))


def equivalent(a: Column, b: Column) -> Column:
    return normalize(a) == normalize(b)


def alias_key(name: Column) -> Column:
    """Lower case without a leading chr. Unlike normalize(), M and MT stay apart."""
    return F.regexp_replace(F.lower(name), "^chr", "")


def apply_style(name: Column, style: str) -> Column:
    """style: 'a' as it is, 's' without prefix, 'l' with a lower-case chr prefix."""
    if style == "s":
        return strip_prefix(name)
    if style == "l":
        return F.concat(F.lit("chr"), strip_prefix(name))
    if style == "a":
        return name
    raise ValueError(f"unknown chromosome style {style!r}: a, s or l")


def follow_habit(target: Column, user: Column) -> Column:
    """The target name with or without chr as the user's own name has it."""
    return (
        F.when(has_prefix(user) & ~has_prefix(target), F.concat(F.lit("chr"), target))
        .when(~has_prefix(user) & has_prefix(target), F.substring(target, 4, 1_000_000))
        .otherwise(target)
    )


def parse_style(text: str) -> str:
    """a/asis, s/short, l/long in any case; anything else raises ValueError."""
    known = {"a": "a", "asis": "a", "as-is": "a", "as_is": "a", "s": "s", "short": "s", "l": "l", "long": "l"}
    if text.lower() not in known:
        raise ValueError(f"unknown chromosome style {text!r}")
    return known[text.lower()]
