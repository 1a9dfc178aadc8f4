"""Quality selection by importance resampling.

Two generative models of hashed word and word-pair counts, one of target text and one of all text, give each document
the logarithm of the ratio of its probabilities; adding Gumbel noise to it and keeping the top k draws k documents
without replacement in proportion to the ratios (Xie et al., "Data selection for language models via importance
resampling", 2023).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, text_of

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 16
#: Bound on the labelled rows that the target model is fitted to; the model of all text counts every row.
TARGETS = 20_000
SEED = 29


class _Words(dict):
    """64-bit hashes of words; emptied when full, so bounded on any corpus."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


def grams(text: str, words: dict) -> np.ndarray:
    """Bucket numbers of the text's words and pairs of neighbouring words."""
    found = TOKEN.findall(text.lower())
    ids = np.fromiter(map(words.__getitem__, found), "u8", len(found))
    with np.errstate(over="ignore"):
        pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        pairs ^= pairs >> np.uint64(33)
    return (np.r_[ids, pairs] & np.uint64(BUCKETS - 1)).astype("i4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = _Words(), np.zeros((2, BUCKETS), "i8")
    for batch in batches:
        for target, text in zip(batch.column("target").to_pylist(), batch.column("text").to_pylist()):
            got = np.bincount(grams(text, words), minlength=BUCKETS)
            counts[0] += got
            if target:
                counts[1] += got
    seen = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(target / all) of each bucket. targets has the ids of target rows; of more than TARGETS, a hash picks some."""
    n = targets.count()
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    ids = targets.select(F.col(id_col).alias("id")).where("id is not null").where(draw <= 1.1 * TARGETS / max(1, n)).distinct().orderBy(draw, "id").limit(TARGETS)
    named = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    marked = named.join(F.broadcast(ids.withColumn("target", F.lit(True))), "id", "left").select(F.coalesce("target", F.lit(False)).alias("target"), "text")
    rows = marked.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    counts = np.ones((2, BUCKETS))
    for bucket, raw, target in rows:
        counts[:, bucket] += raw, target
    share = counts / counts.sum(axis=1, keepdims=True)
    return (np.log(share[1]) - np.log(share[0])).astype("f4") if n else np.zeros(BUCKETS, "f4")


def _weigh(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        weights = [float(ratio[grams(t, words)].sum(dtype="f8")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(weights, pa.float64())], ["id", "mark", "weight"])


def resample(docs: DataFrame, ratio: np.ndarray, share: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, log_weight, gumbel_key, rank (long, from 1), kept (the share of rows with the highest keys).

    The noise is a hash of the id and the text, so a rerun draws the same rows; ties go to the smaller id, nulls first.
    Null and empty texts have weight 0. Repeated rows are drawn one by one; other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text"))
    weighed = named.mapInArrow(lambda it: _weigh(it, ratio), "id long, mark long, weight double")
    noise = -F.log(-F.log((F.pmod(F.xxhash64("id", "mark", F.lit(SEED)), F.lit(1 << 40)) + 0.5) / (1 << 40)))
    keyed = materialise(weighed.withColumn("key", F.col("weight") + noise))
    order = [F.col("key").desc(), F.col("id").asc(), F.col("mark").asc()]
    # The upper bits of the row number are the partition of the range order, the lower ones the place in it.
    sorted_ = materialise(keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = sorted_.withColumn("part", F.shiftright("at", 33))
    before, sizes, k = {}, sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect()), 0
    for part, size in sizes:
        before[part], k = k, k + size
    offsets = spark.createDataFrame(list(before.items()), "part long, before long")
    ranked = placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1)
    return ranked.select(F.col("id").alias(id_col), F.col("weight").alias("log_weight"), F.col("key").alias("gumbel_key"), "rank", (F.col("rank") <= round(share * k)).alias("kept"))
