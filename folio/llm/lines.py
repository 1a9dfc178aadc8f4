"""Line deduplication over range-partitioned line hashes.

Each document's lines become rows (hash, document, position) without text. They are range-partitioned and sorted by
hash, then document from the largest, then position; the whole triple is the range key, so one line that a third of
all documents repeat spreads over as many partitions as it needs. A stream over each partition keeps the first
occurrence of a key (the largest document) and marks the others, holding at most the rows of MIN_DOCS documents. Keys
that touch a partition's edge are settled from two summaries a partition. What comes back is a compressed bitmap of
kept lines for each document; texts stay where they are until the bitmaps are applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, id_key, materialise, partitions, slices, text_of

#: A null id counts as one document, smaller than all others.
NO_ID = -(2**63)
#: Texts are taken up in parts of a batch: at most so many, and so many bytes unless one text alone has more.
PART_ROWS, PART_BYTES = 256, 1 << 20
LINES = "h1 long, h2 long, doc long, mark long, pos int"
MARKS = "kind int, h1 long, h2 long, doc long, mark long, pos int, part int, n long, most long, least long"


def line_key(line: str) -> str:
    """The line without spaces at its ends, A-Z lower-cased."""
    return line.strip(SPACES).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "text", PART_ROWS, PART_BYTES)


def _hash_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    names = ["h1", "h2", "doc", "mark", "pos"]
    digest = xxhash.xxh3_128_digest
    for batch in _parts(batches):
        keys, owner, at = bytearray(), [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for pos, line in enumerate(text.split("\n")):
                if len(line) >= min_chars and len(bare := line.strip(SPACES)) >= min_chars:
                    keys += digest(bare.encode("utf-8", "surrogatepass").lower())
                    owner.append(i)
                    at.append(pos)
        h, take = np.frombuffer(bytes(keys), dtype="<i8").reshape(-1, 2), pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("doc").take(take), batch.column("mark").take(take), pa.array(at, pa.int32())], names)


class _Run:
    """The rows of one key, as they pass by in the order of a partition."""

    def __init__(self, key: tuple[int, int], edge: bool, part: int, min_docs: int) -> None:
        self.key, self.edge, self.part, self.min_docs = key, edge, part, min_docs
        self.n, self.most, self.last, self.wait = 0, 0, None, []

    def feed(self, doc: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> None:
        if self.last is None:
            self.most = int(doc[0])
        self.n += int(np.count_nonzero(np.diff(doc))) + int(self.last is None or self.last != doc[0])
        self.last = int(doc[-1])
        self.wait.append((doc, mark, pos))

    def settled(self) -> bool:
        return self.edge or self.n >= self.min_docs

    def out(self) -> list[tuple[np.ndarray, ...]]:
        """The rows to pass on of those that wait, once the run is settled."""
        got, self.wait = self.wait, []
        if self.edge:
            return got
        return [(d[k], m[k], p[k]) for d, m, p in got if (k := d != self.most).any()]


def _marks(kind: int, run: _Run, rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    doc, mark, pos = (np.concatenate(x) for x in zip(*rows))
    same, fill = (lambda v, t=t: pa.array(np.full(len(doc), v, t)) for t in ("i8", "i4"))
    return pa.RecordBatch.from_arrays([fill(kind), same(run.key[0]), same(run.key[1]), pa.array(doc), pa.array(mark), pa.array(pos), fill(run.part), same(0), same(0), same(0)], [x.split()[0] for x in MARKS.split(", ")])


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """kind 0: a line to drop; 1: a line of a key at this partition's edge; 2: what is here of such a key."""
    from pyspark import TaskContext

    part, run, edges = TaskContext.get().partitionId(), None, []

    def close(run: _Run, last: bool) -> Iterator[pa.RecordBatch]:
        # The last run began here, so its largest document is known; if it has enough documents too, its drops stand.
        run.edge |= last and run.n < min_docs
        if run.edge or last:
            edges.append(run)
        if run.wait and run.settled() and (rows := run.out()):
            yield _marks(1 if run.edge else 0, run, rows)

    for batch in batches:
        h1, h2, doc, mark, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(h1):
            continue
        starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        ends = np.r_[starts[1:], len(h1)]
        # Most keys are of one line; they need no run of their own unless they touch an edge or a batch's end.
        long = (ends - starts > 1) | (starts == 0) | (ends == len(h1))
        for s, e in zip(starts[long], ends[long]):
            key = (int(h1[s]), int(h2[s]))
            if run is None or run.key != key:
                if run is not None:
                    yield from close(run, False)
                run = _Run(key, run is None, part, min_docs)
            run.feed(doc[s:e], mark[s:e], pos[s:e])
            if run.settled() and (rows := run.out()):
                yield _marks(1 if run.edge else 0, run, rows)
    if run is not None:
        yield from close(run, True)
    if edges:
        cols = list(zip(*[(2, r.key[0], r.key[1], 0, 0, 0, part, r.n, r.most, r.last) for r in edges]))
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in MARKS.split(", ")])


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, mark, pos): the lines to drop; mark is a hash of the document's text."""
    spark = docs.sparkSession
    # Written once: the range sampler would hash every line a second time.
    hashed = materialise(_named(docs, id_col, text_col).mapInArrow(lambda it: _hash_lines(it, min_chars), LINES))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("mark"), F.col("pos")]
    dealt = hashed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    marks = materialise(dealt.mapInArrow(lambda it: _stream(it, min_docs), MARKS))
    # Two keys a partition at most, so this is small at any size. A document cut by an edge is on both sides of it.
    at = Window.partitionBy("h1", "h2").orderBy("part")
    sides = marks.where("kind = 2").select("h1", "h2", "part", "n", "most", "least", F.lag("least").over(at).alias("before"))
    whole = sides.groupBy("h1", "h2").agg((F.sum("n") - F.sum(F.when(F.col("before") == F.col("most"), 1).otherwise(0))).alias("docs"), F.max("most").alias("top"))
    common = whole.where(F.col("docs") >= min_docs).select("h1", "h2", "top")
    settled = marks.where("kind = 1").join(F.broadcast(common), ["h1", "h2"]).where("doc <> top")
    return marks.where("kind = 0").select("doc", "mark", "pos").union(settled.select("doc", "mark", "pos"))


def _to_bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, lists = [], batch.column("at")
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for at in (values[s:e] for s, e in zip(ends[:-1], ends[1:])):
            keep = np.ones((int(at.max()) // 8 + 1) * 8, bool)
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(maps, pa.binary())], ["doc", "mark", "bitmap"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, mark, bitmap) of the documents that lose lines.

    bitmap is zlib over bits, the first line in the lowest bit of the first byte; 1 is kept, and lines beyond it are.
    mark is a hash of the text (null as empty), doc the id (null as NO_ID); repeated rows share one bitmap. Other columns
    are ignored; an empty table gives an empty result.
    """
    by = dropped_lines(docs, id_col, text_col, min_chars, min_docs).groupBy("doc", "mark").agg(F.collect_set("pos").alias("at"))
    return by.mapInArrow(_to_bitmap, "doc long, mark long, bitmap binary")


def apply_bitmap(text: str, bitmap: bytes | None) -> tuple[int, list[str]]:
    """How many lines the text has, and those kept."""
    lines = text.split("\n")
    if bitmap is None:
        return len(lines), lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), "u1"), bitorder="little")
    return len(lines), [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        total, dropped, kept = [], [], []
        for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("bitmap").to_pylist()):
            n, lines = apply_bitmap(text, bitmap)
            total.append(n)
            dropped.append(n - len(lines))
            kept.append("\n".join(lines) if bitmap is not None else text)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["doc", "n_lines", "n_dropped", "kept_text"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row a document: id_col, n_lines, n_dropped, kept_text.

    Lines whose key (no spaces at the ends, A-Z lower-cased) has min_chars code points or more and is found in min_docs
    documents or more are dropped except in the largest id that holds them, where all of them stay. A null or empty
    text is one empty line. Rows that share an id are one document: they count once and lose the same keys. A null id
    counts as one document smaller than all others. Other columns are ignored; an empty table gives an empty result.
    """
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    # A document has one bitmap at most, so a partition's are few and small: they are hashed, and no text is sorted.
    met = _named(docs, id_col, text_col).join(maps.hint("shuffle_hash"), ["doc", "mark"], "left").select("doc", "text", "bitmap")
    done = met.mapInArrow(_apply, "doc long, n_lines long, n_dropped long, kept_text string")
    return done.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id_col), "n_lines", "n_dropped", "kept_text")
