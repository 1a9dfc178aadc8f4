"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

A lane is a partition. At first a row's lane is that of the partition it was read in: a lane's rows, sorted by digest
and folded, are its run. A round replaces some bits of the lane by bits of the digest, so that groups of FAN lanes, and
no others, exchange parts of their runs, and each merges the FAN parts it received (a binomial exchange, FAN = 2 ** STEP
of its rounds at a time). What a run retains of a digest is a count and the row that stays. When all bits are the
digest's, each digest has met all its runs. No single root holds them all: the last level is as wide as the first, and
a digest that a third of all rows share is one row a run.

Equality is verified at every level: runs are merged on the SHA-256 digest, an independent 64-bit hash and the length
of the normalised text together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, id_key, join_groups, materialise, partitions, row_hash, text_of

#: Bits of the lane that a round replaces: 2 ** STEP runs meet in a merge.
STEP = 3
KEYS = ["digest", "mark", "width"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, mark, width (of the normalised text) and points (code points of the original) of every row."""
    bare = F.translate(text_of(text_col), SPACES, "")
    named = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("whole"), bare.alias("bare"))
    return named.select("id", F.unhex(F.sha2("bare", 256)).alias("digest"), F.xxhash64("bare").alias("mark"), F.length("bare").alias("width"), F.length("whole").alias("points"))


def _folded(runs: DataFrame, lanes: int) -> DataFrame:
    """The runs dealt to their lanes, one partition a lane, and merged there.

    The exchange is by the lane alone, so grouping by (lane, digest) needs no other: Spark sorts what a lane received
    and folds it as a stream.
    """
    return runs.repartitionById(lanes, F.col("lane").cast("int")).groupBy("lane", *KEYS).agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def merge_runs(rows: DataFrame) -> DataFrame:
    """One row a digest: KEYS, best (less, gone, id, row) and size."""
    bits = max(STEP, (partitions(rows.sparkSession) - 1).bit_length())
    lanes = 1 << bits
    aim = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint").bitwiseAND(lanes - 1)
    first = rows.select(
        *KEYS, F.spark_partition_id().cast("bigint").bitwiseAND(lanes - 1).alias("lane"),
        F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("gone"), "id", "row").alias("best"), F.lit(1).cast("bigint").alias("size"),
    )
    runs = _folded(first, lanes)
    for low in range(0, bits, STEP):
        mask = ((1 << STEP) - 1 << low) & (lanes - 1)
        runs = _folded(runs.withColumn("lane", F.col("lane").bitwiseAND(~mask).bitwiseOR(aim.bitwiseAND(mask))), lanes)
    return runs.select(*KEYS, "best", "size")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of [\\x20\\x09-\\x0D]; of equal texts, the row with the most
    code points stays, then the smallest id. Null and empty texts are equal to each other and to blank ones. A null id
    stays only where no other does (keep_id is then null). Of repeated rows (same id, equal texts of one length) just
    one is kept. Other columns of docs are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = materialise(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    groups = materialise(merge_runs(rows))
    many = groups.where("size > 1").select(*KEYS, F.col("best.id").alias("keep"), F.col("best.row").alias("stays"), "size")
    found = join_groups(rows, many, KEYS, "size")
    alone = F.col("size").isNull()
    return found.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.col("stays"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that dedup() drops, all columns as they were, whatever their names.

    Null and empty texts are copies of blank ones. Of repeated rows (same id, equal texts) the longest stays, and of
    those as long the one with the least hash of all its columns. An empty table gives an empty result.
    """
    verdict = dedup(docs, id_col, text_col).where("kept").select(id_key(id_col).alias("__i"), F.unhex("text_sha256").alias("__g"))
    bare = F.translate(text_of(text_col), SPACES, "")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(row.alias("__row"), id_key(id_col).alias("__i"), F.unhex(F.sha2(bare, 256)).alias("__g"), F.struct((-F.length(text_of(text_col))).alias("n"), row_hash(docs).alias("h")).alias("__n"))
    # Folded before the exchange: rows that repeat an id with equal texts may be a large share of all.
    longest = marked.groupBy("__i", "__g").agg(F.min_by("__row", "__n").alias("__row"))
    return longest.join(verdict, ["__i", "__g"], "left_semi").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
