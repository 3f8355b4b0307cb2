"""Subjects (``/a/b/c``) and wildcard filters: ``*`` is one segment, a last ``>`` one or more."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x1f\x7f]"


def segments(filter_: str) -> list[str]:
    return filter_.split("/")[1:]


def validate_filter(filter_: str) -> str | None:
    """The name of the first error in a filter, None if it is valid."""
    if not filter_:
        return "Empty"
    if filter_[0] != "/":
        return "MissingLeadingSlash"
    parts = segments(filter_)
    for i, part in enumerate(parts):
        if not part:
            return "EmptySegment"
        if part == ">" and i < len(parts) - 1:
            return "MultiNotLast"
        if part not in ("*", ">") and ("*" in part or ">" in part):
            return "PartialWildcard"
        if re.search(CONTROL, part):
            return "ControlByte"
    return None


def filter_regex(filter_: str) -> str:
    """An anchored regular expression; raises on an invalid filter."""
    if error := validate_filter(filter_):
        raise ValueError(f"{error}: {filter_!r}")
    return "^" + "".join({"*": "/[^/]+", ">": "/.+"}.get(s, "/" + re.escape(s)) for s in segments(filter_)) + "$"


def literal_prefix(filter_: str) -> str:
    """What every match starts with; parquet statistics can prune on it."""
    out = ""
    for s in segments(filter_):
        if s in ("*", ">"):
            return out + "/"
        out += "/" + s
    return out


def matches(subject: Column, filter_: str) -> Column:
    """Whether a valid subject matches; the literal prefix goes first, as it can be pushed to the scan."""
    if not any(s in ("*", ">") for s in segments(filter_)):
        filter_regex(filter_)
        return subject == filter_
    return subject.startswith(literal_prefix(filter_)) & subject.rlike(filter_regex(filter_))


def contains(outer: str, inner: str) -> bool:
    """Whether every subject that ``inner`` matches is matched by ``outer``; never true by mistake."""
    a, b = segments(outer), segments(inner)
    for i, part in enumerate(a):
        if i >= len(b):
            return False
        if part == ">":
            return True
        if part == "*":
            if b[i] == ">":
                return False
        elif part != b[i]:
            return False
    return len(a) == len(b)


def subject_error(subject: Column) -> Column:
    """The first error of a subject, null if it is valid. A wildcard counts where it stands, an empty segment or a control
    byte where its segment ends."""
    parts = F.slice(F.split(subject, "/"), 2, 1 << 30)
    errors = F.transform(parts, lambda p: F.when(p.rlike("[*>]"), "ContainsWildcard").when(p == "", "EmptySegment").when(p.rlike(CONTROL), "ControlByte"))
    first = F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))
    return F.when(subject.isNull() | (subject == ""), "Empty").when(~subject.startswith("/"), "MissingLeadingSlash").otherwise(first)


def under(subject: Column, prefix: str) -> Column:
    """Segment-aligned prefix."""
    return (subject == prefix) | subject.startswith(prefix + "/")


def rewrite(subject: Column, hops: Column, max_hops: int, strip: str = "", add: str = "", exclude: tuple[str, ...] = ()) -> Column:
    """A relayed subject's new name, null if it isn't relayed: too many hops, excluded, already there, or not under ``strip``."""
    stop = hops >= max_hops
    for p in exclude:
        stop = stop | under(subject, p)
    if add:
        stop = stop | under(subject, add)
    rest = F.substring(subject, len(strip) + 1, 1 << 30) if strip else subject
    if strip:
        stop = stop | ~subject.startswith(strip + "/")
    return F.when(~stop, F.concat(F.lit(add), rest))
