"""Packing of documents into training sequences in the order of a space-filling curve.

A document's text is hashed to a vector of n-gram counts, which is projected to a few dimensions; the cell's index on a
Hilbert curve is its key. Ranges of (key, id, hash) are cut by bytes of text from a table without texts, so that long
documents, which lie close to each other on the curve, don't gather in few ranges, and their number grows with the
input. Texts are then dealt to their ranges and sorted, and each range packs its documents as a stream, cutting them at
sequence ends: neighbours on the curve share sequences.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, slices, text_of

LENGTH, END_ID = 2048, 1
#: Dimensions of the curve, bits of each, cells' range, buckets of hashed n-grams, bytes of an n-gram.
DIMS, BITS, SPAN, BUCKETS = 4, 10, 4.0, 4096
STEP = 1 << 20
#: Bytes of text that a range holds if there are more ranges than shuffle partitions, and that weigh as one row in
#: cutting ranges.
RANGE_BYTES, UNIT = 1 << 25, 2048
#: A null id sorts before all others.
NO_ID = -(2**63)


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype("f4")


def vector(text: str) -> np.ndarray:
    """Counts of hashed 4-byte n-grams of the UTF-8 text."""
    data, out = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1"), np.zeros(BUCKETS)
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP + 3].astype("u4")
        if len(part) >= 4:
            grams = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
            out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of cells (Skilling's transform, "Programming the Hilbert curve", 2004)."""
    x = cells.astype("i8").T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(texts: list[str], onto: np.ndarray) -> np.ndarray:
    if not texts:
        return np.zeros(0, "i8")
    counts = np.stack([vector(t) for t in texts])
    size = np.linalg.norm(counts, axis=1, keepdims=True)
    place = (counts / np.maximum(size, 1)) @ onto
    cells = np.clip((place + SPAN) / (2 * SPAN) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells, BITS)


#: What keeps a text from being looked up word by word: neighbouring spaces and newlines, the special token, and white
#: space but these two (of the characters below U+0250); letters from there on.
ODD = ("  ", "\n\n", " \n", "\n ", "<|endoftext|>", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
FAR = re.compile("[\u0250-\U0010ffff]")


def odd(text: str) -> bool:
    """Whether a text that isn't empty must be encoded as a whole."""
    return text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ODD) or not text.isascii() and FAR.search(text) is not None


class Tokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by the byte-level BPE of the given files.

    A space between two characters that aren't white space always starts a new pre-token, and a newline between two
    such is one by itself, so texts without other white space are looked up word by word. `ranks` is the same
    vocabulary for the faster library, which is used for words whose letters no Unicode version disputes.
    """

    MOST = 300_000

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> None:
        self.vocabulary, self.full, self.fast = vocabulary, None, None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        outer = self

        class Words(dict):
            def __init__(self, before: str) -> None:
                self.before = before

            def __missing__(self, word: str) -> bytes:
                ids = self[word] = outer.encode(self.before + word)
                return ids

        self.first, self.later = Words(""), Words(" ")
        self.newline = self.encode("\n")

    def encode(self, text: str) -> bytes:
        if self.fast and (text.isascii() or max(text) < "ɐ") and "<|endoftext|>" not in text:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.vocabulary)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if odd(text):
            return self.encode(text)
        if len(self.first) + len(self.later) > self.MOST:
            self.first.clear()
            self.later.clear()
        later, out = self.later.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.first[words[0]] + b"".join(map(later, words[1:])))
        return self.newline.join(out)


_loaded: dict[tuple, Tokens] = {}


def tokens(files: tuple) -> Tokens:
    """One copy a worker process."""
    if files not in _loaded:
        _loaded[files] = Tokens(*files)
    return _loaded[files]


PIECES = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


class Packer:
    """Cuts a stream of documents into sequences. Of the last, short one, the tokens go to sequences of powers of two."""

    def __init__(self, first: int, length: int = LENGTH) -> None:
        self.sequence, self.length, self.used, self.done, self.open = first, length, 0, [], []

    def add(self, doc: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(total - start, self.length - self.used)
            self.open.append((doc, start, n, total, self.sequence, self.used, ids[4 * start : 4 * (start + n)]))
            start += n
            self.used += n
            if self.used == self.length:
                self.done += self.open
                self.open, self.used, self.sequence = [], 0, self.sequence + 1

    def finish(self) -> None:
        rest, left = self.open, self.used
        self.open, self.used = [], 0
        for doc, start, n, total, _, _, ids in rest:
            at = 0
            while at < n:
                room = 1 << (left.bit_length() - 1)
                k = min(n - at, room - self.used)
                self.done.append((doc, start + at, k, total, self.sequence, self.used, ids[4 * at : 4 * (at + k)]))
                at += k
                self.used += k
                if self.used == room:
                    left, self.used, self.sequence = left - room, 0, self.sequence + 1

    def take(self, with_ids: bool) -> pa.RecordBatch:
        rows, self.done = self.done, []
        doc, start, n, total, sequence, offset, ids = zip(*rows)
        cols = [pa.array(x, pa.int64()) for x in (doc, start, n, map(zlib.crc32, ids), total, sequence, offset)]
        return pa.RecordBatch.from_arrays(cols + [pa.array(ids if with_ids else [None] * len(ids), pa.binary())], PIECES)


def _keyed(batches: Iterator[pa.RecordBatch], onto: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text", 256, 1 << 24)):
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(curve_keys(texts, onto), pa.int64()), pa.array(map(len, texts), pa.int64())], ["doc", "mark", "key", "chars"])


def _dealt(batches: Iterator[pa.RecordBatch], onto: np.ndarray, bounds: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Each row's range: the last whose lower bound is not above it."""
    for batch in (part for whole in batches for part in slices(whole, "text", 256, 1 << 24)):
        keys = curve_keys(batch.column("text").to_pylist(), onto).tolist()
        rows = zip(keys, (NO_ID if d is None else d for d in batch.column("doc").to_pylist()), batch.column("mark").to_pylist())
        place = pa.array([max(0, bisect_right(bounds, row) - 1) for row in rows], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64()), place], [*batch.schema.names, "key", "range"])


def _pack(batches: Iterator[pa.RecordBatch], files: tuple, with_ids: bool, length: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, packer = tokens(files), Packer(TaskContext.get().partitionId() << 40, length)
    for batch in (part for whole in batches for part in slices(whole, "text", 1024, 1 << 24)):
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            packer.add(doc, encode(text) + END_ID.to_bytes(4, "little"))
            if len(packer.done) >= 4096:
                yield packer.take(with_ids)
    packer.finish()
    if packer.done:
        yield packer.take(with_ids)


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row a piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian u32).

    A document is its text's ids and END_ID; a null or empty text is END_ID alone. Every id lies in one piece; pieces of
    a sequence follow each other from offset 0. All sequences hold `length` ids but the last few of a partition, whose
    sizes are falling powers of two: nothing is padded. Repeated rows and null ids are documents like any other; other
    columns are ignored; no rows give no rows. length must be a power of two.
    """
    files, spark = (vocabulary, ranks, pattern), docs.sparkSession
    onto = projection()
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text"))
    placed = materialise(named.mapInArrow(lambda it: _keyed(it, onto), "doc long, mark long, key long, chars long"))
    # Rows stand for UNIT characters each, so that ranges of as many rows are ranges of as much text.
    order, last = ["key", "doc", "mark"], F.floor(F.col("chars") / UNIT)
    total = placed.agg(F.coalesce(F.sum(last + 1), F.lit(0)).alias("n")).first()["n"]
    ranges = max(partitions(spark), math.ceil(total * UNIT / RANGE_BYTES))
    units = placed.select("key", F.coalesce("doc", F.lit(NO_ID)).alias("doc"), "mark", F.explode(F.sequence(F.lit(0), last)).alias("unit"))
    cut = units.repartitionByRange(ranges, *order, "unit").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(*order)).alias("least"))
    bounds = sorted(tuple(r["least"]) for r in cut.collect())
    made = named.mapInArrow(lambda it: _dealt(it, onto, bounds), "doc long, mark long, text string, key long, range int")
    dealt = made.repartitionById(ranges, F.col("range")).sortWithinPartitions(*order)
    packed = dealt.select("doc", "text").mapInArrow(lambda it: _pack(it, files, with_ids, length), "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return packed.select(F.col("doc").alias(id_col), *PIECES[1:])
