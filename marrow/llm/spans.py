"""Text spans of named kinds: their order, their written form and its digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa

#: (kind, start, end); code points, end exclusive
Span = tuple[str, int, int]

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS_DDL = "array<struct<kind:string,start:bigint,end:bigint>>"


def ordered(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then by the kinds' order, then by end."""
    place = {k: i for i, k in enumerate(kinds)}
    return sorted(set(spans), key=lambda s: (s[1], place[s[0]], s[2]))


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


def structs(spans: Iterable[Span]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]
