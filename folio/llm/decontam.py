"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments of normalised text, one every STRIDE characters and the last. If a
region of a document is within k edits of a segment of s characters, it shares at least s - q + 1 - k * q of the
segment's q-grams with it, and their diagonals (place in the document less place in the item) differ by k at most. Whole
items are indexed, each q-gram once: the document's are looked up, hits are sorted by document, item and band of
diagonals, and a segment with that many hits in one band is a candidate; bands are 2k + 2 wide and begin every k + 1, so
any k + 1 diagonals lie in one. Candidates are verified by an alignment within the band.

The stride is no more than the edits of a whole segment, so an excerpt is found wherever in its item it starts: with k
edits from SEGMENT + STRIDE - 1 characters, with fewer from SEGMENT, as it lacks at most STRIDE / 2 of some segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import numbered, slices, text_of

WORD = re.compile(r"\w+")
#: Characters of a q-gram, of a segment, from one segment to the next; edits allowed for a character of a segment.
Q, SEGMENT, STRIDE, RATE = 10, 80, 6, 0.08
#: Characters of benchmark text in one broadcast index; a larger benchmark is worked through in parts of this size.
PART = 2_000_000
BITS = 22

_BASE = [pow(0x100000001B3, 2**i, 2**64) for i in range(5)]


def normal(text: str) -> str:
    """Lower-cased words with single spaces."""
    return " ".join(WORD.findall(text.lower()))


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """A polynomial hash, by doubling, of the Q code points from each place on."""
    n = len(points) - Q + 1
    if n <= 0:
        return np.zeros(0, "u8")
    out, have, power, level = None, 0, points.astype("u8") + np.uint64(1), 0
    with np.errstate(over="ignore"):
        while True:
            width = 1 << level
            if Q & width:
                part = power[have : have + n]
                out = part if out is None else out * np.uint64(pow(0x100000001B3, width, 2**64)) + part
                have += width
            if have == Q:
                break
            power = power[:-width] * np.uint64(_BASE[level]) + power[width:]
            level += 1
        out = out ^ out >> np.uint64(31)
        return out * np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass
class Index:
    """Normalised benchmark items, and where each of their q-grams is."""

    names: list
    flats: list[str]
    short: dict[str, list]  # items of fewer than Q characters, by text
    size: np.ndarray  # of an item's segments; edits allowed for one, and hits that it needs
    allowed: np.ndarray
    needed: np.ndarray
    mask: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def segments(self) -> Iterator[tuple[int, str, int]]:
        """(item, text, edits allowed) of every segment."""
        for name, flat, size, k in zip(self.names, self.flats, self.size.tolist(), self.allowed.tolist()):
            for at in segment_starts(len(flat), 0, len(flat)).tolist():
                yield name, flat[at : at + size], k

    @property
    def items(self) -> list[int]:
        return [x[0] for x in self.segments()]

    @property
    def texts(self) -> list[str]:
        return [x[1] for x in self.segments()]

    @property
    def edits(self) -> list[int]:
        return [x[2] for x in self.segments()]


def segment_starts(n: int, low: int, high: int) -> np.ndarray:
    """Where the segments of an item of n characters start, out of low .. high."""
    last = max(0, n - SEGMENT)
    low, high = max(0, low), min(high, last)
    some = np.arange(-(-low // STRIDE) * STRIDE, high + 1, STRIDE)
    return np.r_[some, last].astype("i8") if high == last and last % STRIDE and low <= last else some.astype("i8")


def build(rows: list[tuple[int, str]]) -> Index:
    """Index of (item, text) rows."""
    kept, short = [], {}
    for item, text in rows:
        if len(flat := normal(text)) >= Q:
            kept.append((item, flat))
        elif flat and item not in short.setdefault(flat, []):
            short[flat].append(item)
    names, flats = [x for x, _ in kept], [x for _, x in kept]
    size = np.array([min(len(t), SEGMENT) for t in flats], "i8")
    allowed = np.minimum((size * RATE).astype("i8"), (size - Q) // Q)
    grams = [gram_hashes(code_points(t)) for t in flats]
    flat = np.concatenate(grams) if grams else np.zeros(0, "u8")
    item = np.repeat(np.arange(len(flats)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, "i8")
    order = np.argsort(flat, kind="stable")
    hashes, first = np.unique(flat[order], return_index=True)
    mask = np.zeros(1 << BITS, bool)
    mask[hashes >> np.uint64(64 - BITS)] = True
    return Index(names, flats, short, size, allowed, size - Q + 1 - allowed * Q, mask, hashes, np.r_[first, len(flat)], item[order].astype("i4"), place[order].astype("i4"))


def aligned(item: np.ndarray, begin: np.ndarray, size: int, doc: np.ndarray, low: int, width: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end in the document) of the best alignment of a segment of the item, out of those that begin at
    these places, to a part of the document, if it takes no more than `edits`. Only cells on the `width` diagonals from
    `low` on are visited, for all segments at once."""
    far, n, d = edits + 1, len(doc), np.arange(width)
    at = begin[:, None] + low + d  # the document's next character on each diagonal
    row = np.where((at >= 0) & (at <= n), 0, far)
    for i in range(size):
        other = doc.take(at, mode="clip") != item[begin + i][:, None]
        new = np.where((at >= 0) & (at < n), row + other, far)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        at = at + 1
        bad = (at < 0) | (at > n)
        new[bad] = far
        row = np.minimum(np.minimum.accumulate(new - d, axis=1) + d, far)
        row[bad] = far
        if i % 4 == 3 and row.min() > edits:
            return None
    cost, end = row.min(axis=1), begin + size + low + row.argmin(axis=1)
    found = [(c, max(0, e - size), e) for c, e in zip(cost.tolist(), end.tolist()) if c <= edits]
    return min(found) if found else None


def matches(flats: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) for each normalised text and item, its best segment's region."""
    if not index.flats:
        return []
    joined = "\n".join(flats)
    starts = np.r_[0, np.cumsum([len(f) + 1 for f in flats])]
    h = gram_hashes(code_points(joined))
    at = np.flatnonzero(index.mask[h >> np.uint64(64 - BITS)])
    which = np.minimum(np.searchsorted(index.hashes, h[at]), len(index.hashes) - 1)
    same = index.hashes[which] == h[at]
    at, which = at[same], which[same]
    counts = index.starts[which + 1] - index.starts[which]
    posting = np.repeat(index.starts[which] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    at, item, place = np.repeat(at, counts), index.item[posting].astype("i8"), index.place[posting].astype("i8")
    doc = np.searchsorted(starts, at, "right") - 1
    # Most hits are chance ones: a document has too few of the item.
    pair = doc * len(index.flats) + item
    _, group, held = np.unique(pair, return_inverse=True, return_counts=True)
    keep = held[group] >= index.needed[item]
    if not keep.any():
        return []
    item, place, doc = item[keep], place[keep], doc[keep]
    at = at[keep] - starts[doc]
    shift = int(place.max()) + 1
    band = (at - place + shift) // (index.allowed[item] + 1) + 1
    # Each hit lies in two bands. Within one, hits stay in the document's order, which for a segment's is within k of the item's.
    item, place, doc, at = (np.r_[x, x] for x in (item, place, doc, at))
    band = np.r_[band, band - 1]
    key = (doc * len(index.flats) + item) * (int(band.max()) + 1) + band
    order = np.argsort(key, kind="stable")
    key, item, place, doc, band = key[order], item[order], place[order], doc[order], band[order]
    edge = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
    many = np.diff(edge) >= index.needed[item[edge[:-1]]]
    tries: list[tuple[int, int, int, np.ndarray]] = []
    for i, j in zip(edge[:-1][many].tolist(), edge[1:][many].tolist()):
        x, hits = int(item[i]), np.sort(place[i:j])
        span = int(index.size[x]) - Q
        begin = segment_starts(len(index.flats[x]), int(hits[0]) - span, int(hits[-1]))
        begin = begin[np.searchsorted(hits, begin + span, "right") - np.searchsorted(hits, begin) >= index.needed[x]]
        if len(begin):
            tries.append((int(doc[i]), x, (int(band[i]) - 1) * (int(index.allowed[x]) + 1) - shift, begin))
    # Exact segments first: none is better, and looking for them is cheap.
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for row, x, low, begin in tries:
        size, width = int(index.size[x]), 2 * int(index.allowed[x]) + 2
        for b in begin.tolist():
            start = flats[row].find(index.flats[x][b : b + size], max(0, b + low), max(0, b + low + width - 1 + size))
            if start >= 0:
                best = (0, start, start + size)
                found[row, x] = min(found.get((row, x), best), best)
    exact = set(found)
    for row, x, low, begin in tries:
        if (row, x) not in exact:
            flat, text = code_points(index.flats[x]), code_points(flats[row])
            for part in range(0, len(begin), 4096):
                got = aligned(flat, begin[part : part + 4096], int(index.size[x]), text, low, 2 * int(index.allowed[x]) + 2, int(index.allowed[x]))
                if got:
                    found[row, x] = min(found.get((row, x), got), got)
    return [(row, x, s, e, n) for (row, x), (n, s, e) in sorted(found.items())]


def short_matches(text: str, index: Index) -> Iterator[tuple[object, int, int]]:
    """(item, start, end) of the short items that are a whole line of the text: within a line they can't be told from
    chance. Places are those of the normalised text."""
    at = 0
    for line in text.split("\n"):
        if flat := normal(line):
            for item in index.short.get(flat, ()):
                yield item, at, at + len(flat)
            at += len(flat) + 1


def found_in(texts: list[str], index: Index) -> list[tuple[int, object, int, int, int]]:
    """(row, item id, start, end, edits) for each text and item id that it holds; rows of one item id give one match."""
    best: dict[tuple[int, object], tuple[int, int, int]] = {}
    got = [(row, index.names[x], s, e, n) for row, x, s, e, n in matches([normal(t) for t in texts], index)]
    if index.short:
        got += [(row, item, s, e, 0) for row, t in enumerate(texts) for item, s, e in short_matches(t, index)]
    for row, item, s, e, n in got:
        best[row, item] = min(best.get((row, item), (n, s, e)), (n, s, e))
    return [(row, item, s, e, n) for (row, item), (n, s, e) in sorted(best.items(), key=lambda x: (x[0][0], x[1][1], x[1][2], str(x[0][1])))]


def _parts(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of bounded size that together hold the whole benchmark; the rows of one item id are in one of them."""
    rows = benchmark.select(F.col(id_col).alias("item"), text_of(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = int(total // PART) + 1
    for part in range(parts):
        here = rows.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        yield build([(r["item"], r["text"]) for r in here.toLocalIterator()])


#: Rows and bytes of text that are searched at a time.
ROWS, BYTES = 64, 1 << 21


def _scan(batches: Iterator[pa.RecordBatch], index: Index, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for part in (part for batch in batches for part in slices(batch, "text", ROWS, BYTES)):
        got = found_in(part.column("text").to_pylist(), index)
        row, item, start, end, edits = zip(*got) if got else [()] * 5
        cols = [part.column("doc").take(pa.array(row, pa.int64())), pa.array(item, kind), *[pa.array(x, pa.int64()) for x in (start, end, edits)]]
        yield pa.RecordBatch.from_arrays(cols, ["doc", "item", "start", "end", "edits"])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_col, start, end, edits): one row a document and benchmark item id that it holds a segment of.

    start and end are places in the normalised document (lower-cased words with single spaces), edits those of the
    item's best segment. An item of fewer than Q normalised characters is found where it is a whole line. Repeated rows
    give repeated results; rows that share an item id, a null one too, are one item. A null id stays null; null and empty
    texts on either side match nothing, an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    kind = benchmark.schema[item_col].dataType
    out = None
    for index in _parts(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(index)
        part = named.mapInArrow(lambda it, sent=sent: _scan(it, sent.value, to_arrow_type(kind)), f"doc long, item {kind.simpleString()}, start long, end long, edits long")
        out = part if out is None else out.union(part)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits")


def _clean(batches: Iterator[pa.RecordBatch], index: Index, text: int) -> Iterator[pa.RecordBatch]:
    for part in (part for batch in batches for part in slices(batch, text, ROWS, BYTES)):
        bad = {m[0] for m in found_in([t or "" for t in part.column(text).to_pylist()], index)}
        yield part.take(pa.array([i for i in range(part.num_rows) if i not in bad], pa.int64()))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that find() reports, all columns as they were, whatever their names; rows are filtered where
    they are. Null and empty texts stay, repeated rows go or stay alike, an empty table gives an empty result."""
    rows, text = numbered(docs), docs.columns.index(text_col)
    for index in _parts(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        rows = rows.mapInArrow(lambda it, sent=sent: _clean(it, sent.value, text), rows.schema)
    return rows.toDF(*docs.columns)
