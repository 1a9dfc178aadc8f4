"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

A text's set of five-word shingles gets one MinHash signature, cut into TREES runs of DEPTH values. The runs of a tree,
sorted, are its prefix trie: texts that share the first k values of a run are neighbours there. Matching starts from
whole runs and shortens the prefix value by value until the recall of every text reaches the target (_judge): recall is
measured over all texts, without a sample, from the exact similarity of every link that has been found, which says how
likely it is to be found at each depth. A link found with chance p stands for 1/p links, so those not found count too.

Candidates are never listed as pairs. Texts with neighbours are ordered by the least text that they share a prefix with,
and cut into blocks of at most BLOCK texts that start within BLOCK_BYTES, however many partitions there are. A unit of work is a block, or two blocks between which some
text shares a prefix, with just the texts that do. A task takes one unit at a time, compares exactly the pairs that share
a prefix in any tree, and returns one row a text: its verified links there, and the smallest text it is linked to. A pair
lies in one unit, so it counts once; a group of any size is whole, being more units. Connected components are sought
among verified links alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, join_groups, materialise, partitions, row_hash, slices, text_of

WORD = re.compile(r"\w+")
GRAM, THRESHOLD = 5, Fraction(4, 5)
TREES, DEPTH, TARGET = 16, 6, 0.998
#: Bounds of a block, in texts and bytes of text.
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: How many sampled texts the expectation at the threshold weighs as much as, where few of a sample have links.
PRIOR = 20
#: What a link counts as in the sums of recall: whole numbers, so a sum does not depend on its order.
UNIT = 1 << 30
#: A null id sorts behind all others.
NO_ID = 2**63 - 1

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.random.default_rng(5).integers(0, 2**63, GRAM, dtype="u8") | np.uint64(1)
_PERMUTE = np.random.default_rng(6).integers(0, 2**63, TREES * DEPTH, dtype="u8") | np.uint64(1)
#: Bytes of a run, and bits that a sample's shingles are looked up by first.
RUN, BITS = 4 * DEPTH, 22


class _Words(dict):
    """64-bit hashes of words; emptied when full and without the longest, so bounded on any corpus."""

    def __missing__(self, word: str) -> int:
        got = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= 300_000:
                self.clear()
            self[word] = got
        return got


def shingles(text: str, words: dict, gram: int = GRAM) -> tuple[bytes, np.ndarray]:
    """A digest of the normalised text and its distinct shingle hashes.

    Words are lower-cased runs of word characters. A text of fewer words than a shingle has one shingle of them all; one
    without words has none, and its digest is that of the text.
    """
    found = WORD.findall(text.lower())
    if not found:
        return xxhash.xxh3_128_digest(b"\0" + text.encode("utf-8", "surrogatepass")), np.zeros(0, "u8")
    ids = np.fromiter(map(words.__getitem__, found), "u8", len(found))
    digest = xxhash.xxh3_128_digest(ids.tobytes())
    width = min(gram, len(ids))
    n = len(ids) - width + 1
    with np.errstate(over="ignore"):
        h = np.full(n, width, "u8")
        for i in range(width):
            h += ids[i : i + n] * _PLACE[i % GRAM]
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
    return digest, np.unique(h)


def signature(found: np.ndarray) -> np.ndarray:
    out = np.full(len(_PERMUTE), 2**64 - 1, "u8")
    for at in range(0, len(found), 256):
        np.minimum(out, (found[at : at + 256, None] * _PERMUTE[None, :]).min(axis=0), out=out)
    return out


def runs_of(found: np.ndarray) -> np.ndarray:
    """The runs, a row a tree: the low halves of the signature's values, which order as their big-endian bytes do."""
    return (signature(found) & np.uint64(0xFFFFFFFF)).astype(">u4").reshape(TREES, DEPTH)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first values are equal along the last axis."""
    return np.cumprod(a == b, axis=-1).sum(axis=-1)


def expected_recall(depth: int, similarity: float = float(THRESHOLD)) -> float:
    """The chance that two texts of this similarity share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


# -- the depth


def deepest(recall: list[float], target: float = TARGET) -> tuple[int, float]:
    """Shorten whole runs value by value until the recall reaches the target; that depth, and its recall."""
    depth = DEPTH
    while depth > 1 and recall[depth] < target:
        depth -= 1
    return depth, recall[depth]


def chances(similarity: np.ndarray, depth: int) -> np.ndarray:
    """How many links found at this depth stand for, by depth 0 .. DEPTH that these would be found at, in UNITs; depth 0 finds all."""
    p = 1 - (1 - similarity[:, None] ** np.arange(DEPTH + 1)) ** TREES
    return np.rint(UNIT * p / p[:, depth, None]).astype("i8")


# -- recall against brute force over given texts; the queries measure it over all texts instead (_measured)


@dataclass
class Sample:
    """Shingle sets of sampled texts, by shingle."""

    digests: list[bytes]
    sizes: np.ndarray
    runs: np.ndarray
    mask: np.ndarray
    shingle: np.ndarray
    start: np.ndarray
    owner: np.ndarray


def build_sample(texts: list[str]) -> Sample:
    words, sets = _Words(), {}
    for t in texts:
        digest, found = shingles(t, words)
        if len(found):
            sets.setdefault(digest, found)
    held = list(sets.values())
    flat = np.concatenate(held) if held else np.zeros(0, "u8")
    owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
    order = np.argsort(flat, kind="stable")
    shingle, start = np.unique(flat[order], return_index=True)
    mask = np.zeros(1 << BITS, bool)
    mask[shingle >> np.uint64(64 - BITS)] = True
    runs = np.stack([runs_of(x) for x in held]) if held else np.zeros((0, TREES, DEPTH), ">u4")
    return Sample(list(sets), np.array([len(x) for x in held], "i8"), runs, mask, shingle, np.r_[start, len(flat)], owner[order])


def sampled_links(digest: bytes, found: np.ndarray, runs: np.ndarray, sample: Sample) -> list[int]:
    """Of each sampled text that this one is truly linked to: its number and the deepest prefix that a tree shares."""
    near = found[sample.mask[found >> np.uint64(64 - BITS)]]
    if not len(near) or not len(sample.shingle):
        return []
    at = np.minimum(np.searchsorted(sample.shingle, near), len(sample.shingle) - 1)
    at = at[sample.shingle[at] == near]
    if not len(at):
        return []
    width = sample.start[at + 1] - sample.start[at]
    place = np.repeat(sample.start[at] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
    shared = np.bincount(sample.owner[place], minlength=len(sample.sizes))
    p, q = THRESHOLD.numerator, THRESHOLD.denominator
    linked = np.flatnonzero((shared > 0) & (shared * (p + q) >= p * (sample.sizes + len(found))))
    return [int(k) * (DEPTH + 1) + int(common_prefix(sample.runs[k], runs).max()) for k in linked if sample.digests[k] != digest]


def measured_recall(counts: dict[int, int]) -> list[float]:
    """Recall by depth 0 .. DEPTH: the mean over sampled texts with links, and PRIOR more of the expected recall."""
    by: dict[int, np.ndarray] = {}
    for key, n in counts.items():
        by.setdefault(key // (DEPTH + 1), np.zeros(DEPTH + 1))[key % (DEPTH + 1)] += n
    shares = [np.cumsum(x[::-1])[::-1] / x.sum() for x in by.values()]
    total = np.sum(shares, axis=0) if shares else np.zeros(DEPTH + 1)
    return [float((total[d] + PRIOR * expected_recall(d)) / (len(shares) + PRIOR)) for d in range(DEPTH + 1)]


def fit_depth(counts: dict[int, int], target: float = TARGET) -> tuple[int, float]:
    return deepest(measured_recall(counts), target)


# -- signatures and tries


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for whole in batches:
        for batch in slices(whole, "text", 4096, 1 << 24):
            digests, runs, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                digest, found = shingles(text, words)
                digests.append(digest)
                sizes.append(len(text))
                runs.append(runs_of(found).tobytes() if len(found) else None)
            cols = [batch.column("doc"), batch.column("mark"), pa.array(digests, pa.binary()), pa.array(runs, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "mark", "digest", "runs", "chars"])


def _matched(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition of the sorted tries that share a prefix of this depth with the row before or behind; the
    partition's first and last row may with rows beyond it, so they pass."""
    held, joined = None, True  # the last row, whose follower is still to come, and whether it shares one with its leader
    for batch in batches:
        if not batch.num_rows:
            continue
        here = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n, tree = here.num_rows, here.column("tree").to_numpy()
        run = np.frombuffer(b"".join(here.column("run").to_pylist()), ">u4").reshape(n, DEPTH)
        same = (tree[1:] == tree[:-1]) & (run[1:, :depth] == run[:-1, :depth]).all(axis=1)
        keep = np.r_[joined, same] | np.r_[same, False]
        joined = bool(same[-1]) if n > 1 else joined
        yield here.slice(0, n - 1).filter(pa.array(keep[:-1]))
        held = here.slice(n - 1)
    if held is not None:
        yield held


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts and characters of a partition lie before each of its ordered texts."""
    from pyspark import TaskContext

    part, texts, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n, chars = batch.num_rows, batch.column("chars").to_numpy()
        start = size + np.cumsum(chars) - chars
        cols = [batch.column("node"), batch.column("chars"), pa.array([part] * n, pa.int32()), pa.array(texts + np.arange(n)), pa.array(start)]
        yield pa.RecordBatch.from_arrays(cols, ["node", "chars", "part", "nth", "start"])
        texts, size = texts + n, size + int(chars.sum())


def _blocks(labelled: DataFrame, parts: int) -> DataFrame:
    """(node, block): the texts by label, cut into blocks of at most BLOCK texts that start within BLOCK_BYTES.

    Blocks go on from one partition to the next, as short ones would raise the number of blocks that a group's texts
    meet. What lies before a partition comes from one row a partition.
    """
    order = ["label", "node"]
    dealt = labelled.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialise(dealt.mapInArrow(_placed, "node long, chars long, part int, nth long, start long"))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    led = sizes.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"led_{c}") for c in ("n", "size")])
    block = F.floor((F.col("led_n") + F.col("nth")) / BLOCK) + F.floor((F.col("led_size") + F.col("start")) / BLOCK_BYTES)
    return materialise(placed.join(F.broadcast(led), "part").select("node", block.alias("block")))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text"))


# -- verification


def overlap(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sets[rows] x sets[cols]: how many members a pair shares, and how many its two sets have in sum."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    number, size = np.cumsum(new) - 1, np.diff(np.r_[np.flatnonzero(new), len(flat)])
    many = size > 1  # a shingle of one text is shared with none
    place = np.where(many, np.cumsum(many) - 1, -1)[number]
    owner, place = owner[place >= 0], place[place >= 0]
    shared = np.zeros((len(rows), len(cols)), "f4")
    for low in range(0, int(many.sum()), 4096):
        here = (place >= low) & (place < low + 4096)
        x = np.zeros((len(sets), 4096), "f4")
        x[owner[here], place[here] - low] = 1
        shared += x[rows] @ x[cols].T
    size = np.array([len(s) for s in sets], "i8")
    return np.rint(shared).astype("i8"), size[rows][:, None] + size[cols][None, :]


def linked(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """Which of sets[rows] x sets[cols] have a Jaccard similarity of the threshold or more, in exact integers."""
    return similar(*overlap(sets, rows, cols), threshold)


def similar(shared: np.ndarray, both: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    p, q = threshold.numerator, threshold.denominator
    return shared * (p + q) >= p * both


def _roots(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index of each index's connected component."""
    root, open_ = np.full(len(adjacent), -1), np.ones(len(adjacent), bool)
    for i in range(len(adjacent)):
        if open_[i]:
            group, edge = np.zeros(len(adjacent), bool), np.zeros(len(adjacent), bool)
            group[i] = edge[i] = True
            while edge.any():
                edge = adjacent[edge].any(axis=0) & ~group
                group |= edge
            root[group], open_[group] = i, False
    return root


def _verify_unit(low: int, high: int, held: dict[int, tuple[int, str, bytes]], depth: int, words: dict) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Texts of a unit, their verified links between blocks low and high, the smallest text each is linked to, and what
    its links stand for (chances)."""
    nodes = sorted(held)
    of = np.array([held[n][0] for n in nodes])
    a, b = np.flatnonzero(of == low), np.flatnonzero(of == high)
    met = np.zeros((len(nodes), len(nodes)), bool)
    stand = np.zeros((len(nodes), DEPTH + 1), "i8")
    if len(nodes) > 1 and len(a) and len(b):
        prefix = np.frombuffer(b"".join(held[n][2] for n in nodes), ">u4").reshape(len(nodes), TREES, DEPTH)[:, :, :depth]
        key = np.unique(np.ascontiguousarray(prefix).view(f"S{4 * depth}").reshape(-1), return_inverse=True)[1].reshape(len(nodes), TREES)
        share = (key[a][:, None, :] == key[b][None, :, :]).any(axis=2) & (a[:, None] != b[None, :])
        if share.any():
            shared, both = overlap([shingles(held[n][1], words)[1] for n in nodes], a, b)
            x, y = np.nonzero(share & similar(shared, both))
            met[a[x], b[y]] = True
            each = chances(shared[x, y] / (both - shared)[x, y], depth)
            np.add.at(stand, a[x], each)
            if low != high:  # within a block, a pair is met from either side
                np.add.at(stand, b[y], each)
    met |= met.T
    return nodes, met.sum(axis=1), np.array(nodes, "i8")[_roots(met)], stand


def _verify(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit; the texts of one unit are held at a time."""
    words, unit, held = _Words(), None, {}

    def done() -> pa.RecordBatch:
        *cols, stand = _verify_unit(*unit, held, depth, words)
        stood = pa.array([x if x[0] else None for x in stand.tolist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), stood], ["node", "links", "root", "stand"])

    for whole in batches:
        for batch in slices(whole, "text", 1024, 1 << 23):
            for low, high, node, block, text, runs in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "node", "block", "text", "runs"))):
                if unit != (low, high):
                    if unit is not None:
                        yield done()
                    unit, held = (low, high), {}
                held.setdefault(node, (block, text, runs))
    if unit is not None:
        yield done()


def _units(near: DataFrame, home: DataFrame) -> DataFrame:
    """(low, high, node, block): the units that each text is in. A text is in that of its own block, and in that of its
    own and another block where it shares a prefix with a text of the other."""
    placed = materialise(near.join(home, "node").select("bucket", "node", "block"))
    spread = placed.groupBy("bucket").agg(F.sort_array(F.collect_set("block")).alias("blocks"), F.count(F.lit(1)).alias("n")).where("size(blocks) > 1")
    wide = join_groups(placed, materialise(spread), ["bucket"], "n").where("n is not null")
    # A text meets the same blocks in many trees: these are united before they become rows.
    met = wide.groupBy("node", "block").agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks"))
    across = met.select("node", "block", F.explode("blocks").alias("other")).where("block <> other")
    units = across.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "block")
    return units.unionByName(home.select(F.col("block").alias("low"), F.col("block").alias("high"), "node", "block"))


def _measured(verified: DataFrame) -> list[float]:
    """Recall by depth of the text that has the least, of all texts with links; without any, the threshold's expectation."""
    by = verified.where("stand is not null").groupBy("node").agg(*[F.sum(F.col("stand")[d]).alias(f"s{d}") for d in range(DEPTH + 1)])
    worst = by.agg(*[F.min(F.col(f"s{d}") / F.col("s0")) for d in range(DEPTH + 1)]).first()
    return [expected_recall(d) if x is None else x for d, x in enumerate(worst)]


def _round(kept: DataFrame, texts: DataFrame, named: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The texts that share a prefix of this depth with others, as (node, doc, mark, runs), and their verified rows."""
    parts = partitions(kept.sparkSession)
    keyed = kept.select(F.xxhash64("tree", F.substring("run", 1, 4 * depth)).alias("bucket"), "node", "chars")
    buckets = materialise(keyed.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    near = materialise(join_groups(keyed, buckets, ["bucket"], "n").where("n is not null").select("bucket", "node", "chars", "least"))
    labelled = near.groupBy("node").agg(F.min("least").alias("label"), F.first("chars").alias("chars"))
    home = _blocks(labelled, parts)
    members = materialise(home.join(texts, "node").select("node", "doc", "mark", "runs"))
    whole = named.join(members, ["doc", "mark"]).select("node", "text", "runs")
    dealt = _units(near, home).join(whole, "node").repartition(parts, "low", "high").sortWithinPartitions("low", "high", "node")
    return members, materialise(dealt.mapInArrow(lambda it: _verify(it, depth), "node long, links long, root long, stand array<long>"))


def _judge(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows' (doc, mark, digest), and of each digest what there is to say."""
    parts = partitions(docs.sparkSession)
    named = _named(docs, id_col, text_col)
    rows = materialise(named.mapInArrow(_sign, "doc long, mark long, digest binary, runs binary, chars long"))
    by = rows.groupBy("digest", "runs").agg(F.min(F.struct("doc", "mark", "chars")).alias("best"), F.count(F.lit(1)).alias("copies"))
    texts = materialise(by.select("digest", "runs", "best.*", "copies", F.monotonically_increasing_id().alias("node")))
    if not rows.groupBy("doc", "mark").count().where("count > 1").isEmpty():
        named = named.dropDuplicates(["doc", "mark"])  # repeated rows are folded before they meet in one task

    # The tries: every run of every text, sorted. What has no neighbour at the depth that does for any link is gone after this.
    least, order = deepest([expected_recall(d) for d in range(DEPTH + 1)])[0], ["tree", "run", "node"]
    trie = texts.where("runs is not null").select("node", "chars", "runs", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trie = trie.select("tree", F.expr(f"substring(runs, tree * {RUN} + 1, {RUN})").alias("run"), "node", "chars")
    dealt = trie.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = materialise(dealt.mapInArrow(lambda it: _matched(it, least), "tree int, run binary, node long, chars long"))

    depth = DEPTH
    members, verified = _round(kept, texts, named, depth)
    while depth > least and (fit := deepest(_measured(verified))[0]) < depth:
        depth = max(fit, least)
        members, verified = _round(kept, texts, named, depth)

    group = components(verified.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "class")
    links = verified.groupBy("node").agg(F.sum("links").alias("links")).join(group, "node", "left").join(members.drop("runs"), "node")
    full = materialise(links.select("node", "links", "doc", "mark", F.coalesce("class", "node").alias("class")))
    tops = materialise(full.groupBy("class").agg(F.min(F.struct("doc", "mark")).alias("top"), F.count(F.lit(1)).alias("texts")))
    settled = join_groups(full.select("node", "links", "class"), tops, ["class"], "texts").select("node", "links", "top")
    said = texts.join(settled, "node", "left").select(
        "digest", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce(F.col("top.doc"), "doc").alias("top_doc"), F.coalesce(F.col("top.mark"), "mark").alias("top_mark"),
    )
    return rows.select("doc", "mark", "digest"), said


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, class_id, n_links, n_copies.

    n_links counts the other different texts (as normalised) with a Jaccard similarity of five-word shingles of 0.8 or
    more, n_copies the other rows of the same normalised text. class_id is the smallest id of the documents that links
    and copies connect, its own where there are none. Texts of one to four words have one shingle; texts without words
    equal only their exact copies, null ones being empty. A null id comes last and is a class_id only where no other
    is in the class. Repeated rows are copies. Other columns are ignored; an empty table gives an empty result.
    """
    rows, said = _judge(docs, id_col, text_col)
    met = join_groups(rows, materialise(said), ["digest"], "copies")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return met.select(known("doc").alias(id_col), known("top_doc").alias("class_id"), "links", (F.col("copies") - 1).alias("n_copies")).withColumnRenamed("links", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near_join(), that of its smallest id, all columns as they were.

    Nulls, empty texts and ids are taken as there. Of rows that share that id, the text of the least hash stays, and of
    repeated rows the one with the least hash of all its columns. An empty table gives an empty result.
    """
    _, said = _judge(docs, id_col, text_col)
    tops = said.select(F.col("top_doc").alias("__d"), F.col("top_mark").alias("__m")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(row.alias("__row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__d"), F.xxhash64(text_of(text_col)).alias("__m"), row_hash(docs).alias("__h"))
    # Folded before the exchange, as one row may be repeated very often.
    one = marked.groupBy("__d", "__m").agg(F.min_by("__row", "__h").alias("__row"))
    return one.join(tops, ["__d", "__m"], "left_semi").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
