"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of characters that keys are made of. Within it, for each character class, a window slides over
each run of that class; its entropy follows from counts that change by one character in and one out a step. Windows
over the class's threshold, joined where they touch, are spans, unless the allow-list names what they hold. A window that
overlaps a placeholder does not count; those beside it do.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Class: (its runs, window, bits a character from which a window counts).
CLASSES = {
    "hex": (re.compile(r"[0-9a-fA-F]{24,}"), 24, 3.0),
    "alnum": (re.compile(r"[A-Za-z0-9]{20,}"), 20, 3.9),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]{32,}"), 32, 4.3),
}
#: What a span holds that is no secret: words alone, numbers alone, dates and identifiers with dashes.
ALLOW = [
    # Possessive, so that no run of joined words can be read in two ways.
    re.compile(r"(?:[A-Z]{2,}+|[A-Za-z]?+[a-z]*+)(?:[-_/+=](?:[A-Z]{2,}+|[A-Za-z]?+[a-z]*+))*+"),
    re.compile(r"[0-9+/_=-]++"),
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
]


def _onward(rest: str) -> str:
    """A pattern of as many of these characters as follow."""
    return f"(?:{rest[0]}{_onward(rest[1:])})?" if rest else ""


#: What no secret's window overlaps: ordered alphabets, as far as they go, and words of examples.
PLACEHOLDER = re.compile(f"0123456789|abcdefghij{_onward('klmnopqrstuvwxyz')}|ABCDEFGHIJ{_onward('KLMNOPQRSTUVWXYZ')}|example|EXAMPLE|x{{8,}}|X{{8,}}")

_LOG = [0.0, 0.0] + [n * math.log2(n) for n in range(2, 257)]


def windows(text: str, width: int, bar: float) -> list[tuple[int, int]]:
    """The joined windows of `width` characters with an entropy of `bar` bits or more that overlap no placeholder."""
    counts: dict[str, int] = {}
    total, found = 0.0, []
    barred = bytearray(len(text))  # by start of a window
    for m in PLACEHOLDER.finditer(text):
        low = max(0, m.start() - width + 1)
        barred[low : m.end()] = b"\1" * (m.end() - low)
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _LOG[n + 1] - _LOG[n]
        counts[c] = n + 1
        if i >= width:
            out = text[i - width]
            n = counts[out]
            total += _LOG[n - 1] - _LOG[n]
            counts[out] = n - 1
        if i >= width - 1 and not barred[i - width + 1] and math.log2(width) - total / width >= bar - 1e-9:
            start = i - width + 1
            if found and start <= found[-1][1]:
                found[-1][1] = i + 1
            else:
                found.append([start, i + 1])
    return [tuple(x) for x in found]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def entropy_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of high entropy that no base span covers and the allow-list does not name."""
    found: set[tuple[int, int]] = set()
    for m in CANDIDATE.finditer(text):
        if any(p.fullmatch(m[0]) for p in ALLOW):
            continue
        for runs, width, bar in CLASSES.values():
            for run in runs.finditer(m[0]):
                at = m.start() + run.start()
                for s, e in windows(run[0], width, bar):
                    if not any(p.fullmatch(run[0][s:e]) for p in ALLOW):
                        found.add((at + s, at + e))
    joined: list[list[int]] = []
    for s, e in sorted(found):
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    # Covered is what begins behind a base span's start and ends before the furthest end of those that began by then.
    ordered = sorted((b, f) for _, b, f in base)
    starts, furthest = [b for b, _ in ordered], list(accumulate((f for _, f in ordered), max))
    covered = lambda s, e: (k := bisect_right(starts, s)) > 0 and furthest[k - 1] >= e
    return [("entropy", s, e) for s, e in joined if not covered(s, e)]


def order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def _scan(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text", 2048, 1 << 23)):
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            rows.append([{"kind": k, "start": s, "end": e} for k, s, e in order(base + entropy_spans(text, base))])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], ["id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): the spans (kind, start, end; code points, end exclusive) of each row's text by start, then kind.

    Every row gives a row, repeated ones and null ids too; null and empty texts have no spans. Other columns are
    ignored; an empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    held = docs.schema[id_col].dataType.simpleString()
    return named.mapInArrow(lambda it: _scan(it, kind), f"id {held}, spans {SPANS}").select(F.col("id").alias(id_col), "spans")
