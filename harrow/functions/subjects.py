"""Message subjects: dot-separated names that routes and subscriptions use."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def make_subject(kind: str, *cols, prefix: str = "j1939") -> Column:
    """Subject of a message.

    raw(pgn), data(name), filter(name), gps(class); bus(pgn, source,
    destination) has no kind token and writes NONE for a broadcast.
    """
    parts = [_text(c) for c in cols]
    if kind == "bus":
        pgn, source, destination = parts
        return F.concat_ws(
            ".", F.lit(prefix), pgn, source, F.coalesce(destination, F.lit("NONE")))
    if kind not in ("raw", "data", "filter", "gps"):
        raise ValueError(f"unknown subject kind {kind!r}")
    return F.concat_ws(".", F.lit(prefix), F.lit(kind), *parts)


def subject_match(c, pattern: str) -> Column:
    """Does a subject match a subscription?

    ``*`` stands for one token, a closing ``>`` for one or more. A pattern
    without ``*`` compiles to a comparison or a prefix test, which a file
    scan can push down.
    """
    subject = F.col(c) if isinstance(c, str) else c
    tokens = pattern.split(".")
    if "*" not in tokens:
        if tokens[-1] != ">":
            return subject == F.lit(pattern)
        stem = pattern[:-1]
        return subject.startswith(stem) & (F.length(subject) > len(stem))
    open_end = tokens[-1] == ">"
    body = tokens[:-1] if open_end else tokens
    expression = r"\.".join(r"[^.]+" if t == "*" else re.escape(t) for t in body)
    return subject.rlike("^" + expression + (r"\..+$" if open_end else "$"))
