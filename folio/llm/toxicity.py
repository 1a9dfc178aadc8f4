"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed word pieces is trained from documents confirmed as toxic and from unlabelled text, which
holds toxic documents too: with p the share of toxic documents, the risk of the negatives is that of the unlabelled
less p times that of the positives, and where this estimate falls below zero its gradient is reversed
(Kiryo et al., "Positive-unlabeled learning with non-negative risk estimator", 2017).

A document's features are those of its distinct words: the word, and its pieces of LOW to HIGH characters with marked
ends. Features that the sample's positives hold seldom, or that clean text holds too, get no weight, and
weights are not negative: a long clean text can't outweigh an insult. A word adds the same sum wherever it stands, so
scoring is one lookup a word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, numbered, partitions, text_of

WORD = re.compile(r"\w+")
DIM = 1 << 20
LOW, HIGH = 4, 5
#: Characters of the longest word that is cached, and of a part of a word whose pieces are held at a time.
LONG, CHUNK = 64, 1 << 16
#: A feature needs this many of the sampled positives, enough of them that EVIDENCE unlabelled texts would hold it too if
#: none but toxic texts did, and to be toxic text's to the share PURITY.
LEAST, EVIDENCE, PURITY = 5, 3.0, 0.75
#: Bounds on the training sample, in documents.
POSITIVES, UNLABELLED = 4000, 12000
#: A document counts as toxic from this score.
BAR = 0.7
STEPS, RATE, DECAY = 1500, 0.1, 1e-5


def pieces(word: str) -> np.ndarray:
    """Feature numbers of a word, which is a whole clause where text has no spaces."""
    marked = f"^{word}$"
    found = {zlib.crc32(marked.encode("utf-8", "surrogatepass")) % DIM}
    for at in range(0, len(marked), CHUNK):  # all pieces that begin in these characters
        part = marked[at : at + CHUNK + HIGH - 1]
        grams = {part[i : i + n] for n in range(LOW, HIGH + 1) for i in range(len(part) - n + 1)}
        found.update(zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIM for x in grams)
    return np.fromiter(found, "u4", len(found))


class Cache(dict):
    """What a function gives for words; emptied when full, and without the words of over LONG characters, so it is
    bounded on any corpus."""

    def __init__(self, make: Callable, most: int = 100_000) -> None:
        self.make, self.most = make, most

    def __missing__(self, word: str):
        if len(word) > LONG:
            return self.make(word)
        if len(self) >= self.most:
            self.clear()
        got = self[word] = self.make(word)
        return got


def features(text: str, cache: Cache) -> np.ndarray:
    """The features of a document's distinct words, each as often as words have it."""
    held = [cache[w] for w in set(WORD.findall(text.lower()))]
    return np.concatenate(held) if held else np.zeros(0, "u4")


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    prior: float

    def word(self, word: str) -> float:
        return sum(self.weights.get(x, 0.0) for x in pieces(word).tolist())

    def score(self, text: str, cache: Cache) -> float:
        z = self.bias + sum(map(cache.__getitem__, set(WORD.findall(text.lower()))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(theta: np.ndarray, positive: tuple, unlabelled: tuple, prior: float) -> tuple[float, float, np.ndarray]:
    """The positives' risk, the negatives' (unlabelled less positives), and the gradient that training follows: that of
    their sum, or, where the negatives' risk is below zero, that of raising it. The samples are (column of each feature
    held, its row, number of rows); theta has the bias last."""
    (cp, of_p, n_pos), (cu, of_u, n_unl) = positive, unlabelled
    zp, zu = (np.bincount(of, theta[cols], n) + theta[-1] for cols, of, n in (positive, unlabelled))
    on_positive = prior * np.logaddexp(0, -zp).mean()
    on_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    # By score: the gradient of the positives' risk, and of the negatives' as unlabelled less positives.
    gp, hp, gu = -prior * _sigmoid(-zp) / n_pos, -prior * _sigmoid(zp) / n_pos, _sigmoid(zu) / n_unl
    gp, gu = (gp + hp, gu) if on_negative >= 0 else (-hp, -gu)
    g = np.zeros(len(theta)) + np.bincount(cp, gp[of_p], len(theta)) + np.bincount(cu, gu[of_u], len(theta))
    g[-1] += gp.sum() + gu.sum()
    return on_positive, on_negative, g


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: list[int], prior: float, signed: bool = False) -> Model:
    """Fit weights of the chosen features, which the rows name by place, by Adam on the non-negative logistic risk.

    Weights are not negative unless signed. Without either kind of sample, nothing is toxic.
    """
    if not positive or not unlabelled:
        return Model({}, -10.0, prior)
    sides = [(np.concatenate(rows).astype("i8"), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)) for rows in (positive, unlabelled)]
    # The state of each parameter, the bias last: value and Adam's two moments.
    theta, m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    theta[-1] = -2.0
    for t in range(1, STEPS + 1):
        g = risk(theta, *sides, prior)[2]
        g[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if not signed:
            theta[:-1] = np.maximum(theta[:-1], 0)
    return Model({f: w for f, w in zip(chosen, theta.tolist()) if w}, float(theta[-1]), prior)


def held_out(id_col: str) -> Column:
    """Whether a row is of the fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, cache = np.zeros((2, DIM), "i8"), Cache(pieces)
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            counts[int(toxic)][np.unique(features(text, cache))] += 1
    seen = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1][seen]), pa.array(counts[0][seen])], ["feature", "pos", "unl"])


def _placed(batches: Iterator[pa.RecordBatch], chosen: list[int]) -> Iterator[pa.RecordBatch]:
    place = np.full(DIM, -1, "i4")
    place[chosen] = np.arange(len(chosen))

    def held(word: str) -> np.ndarray:
        at = place[pieces(word)]
        return at[at >= 0]

    cache = Cache(held)
    for batch in batches:
        made = [features(t, cache).astype("i4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(made, pa.binary())], ["toxic", "at"])


def _drawn(rows: DataFrame, seed: int, most: int) -> DataFrame:
    """At most so many of the rows (id, text): those of the least hashes of both, whatever the partitions."""
    h = F.xxhash64("id", "text", F.lit(seed))
    share = F.pmod(h, F.lit(1 << 30)) / (1 << 30)
    # A little over the bound by hash, then the bound itself: what is sorted is no more than that many rows.
    return rows.where(share <= 1.2 * most / max(1, rows.count())).orderBy(share, "id", "text").limit(most)


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, float] | None:
    """The training sample (toxic, text) as a scratch table, and the prior; None where no row is labelled 1."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("toxic"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    if not n_toxic:
        return None
    named = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).where(~held_out("id"))
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    picked = known.where("toxic").select("id").where(draw <= 1.2 * POSITIVES / n_toxic).distinct().orderBy(draw, "id").limit(POSITIVES)
    positive = _drawn(named.join(F.broadcast(picked), "id"), 19, POSITIVES).dropDuplicates(["text"])
    other = _drawn(named, 23, UNLABELLED)
    both = positive.select(F.lit(True).alias("toxic"), "text", "id").union(other.select(F.lit(False).alias("toxic"), "text", "id"))
    # Texts, not features, lie in the scratch table: these would be several times as large. The limits left few partitions.
    return materialise(both.repartition(partitions(docs.sparkSession), F.xxhash64("id", "text")).drop("id")), n_toxic / n


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most POSITIVES different texts labelled 1 and UNLABELLED rows of docs of any label or none, out of the
    learning folds; both are those of the least hashes, so neither rows' order nor partitions change the model. The prior
    is the share of 1 among all labels of these folds."""
    drawn = sampled(docs, labels, id_col, text_col, label_col)
    if drawn is None:
        return Model({}, -10.0, 0.0)
    sample, prior = drawn
    n_pos, n_unl = sample.agg(F.count(F.when(F.col("toxic"), 1)), F.count(F.when(~F.col("toxic"), 1))).first()
    counts = sample.mapInArrow(_frequencies, "feature long, pos long, unl long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    expected = prior * n_unl / max(1, n_pos) * F.col("pos")  # unlabelled texts that would hold a feature of toxic text alone
    chosen = sorted(r["feature"] for r in counts.where((F.col("pos") >= LEAST) & (expected >= EVIDENCE) & (expected >= PURITY * (F.col("unl") + 0.5))).collect())
    rows = sample.mapInArrow(lambda it: _placed(it, chosen), "toxic boolean, at binary").collect()
    split = [[np.frombuffer(bytes(r["at"]), "i4") for r in sorted(rows, key=lambda r: bytes(r["at"])) if r["toxic"] == kind] for kind in (True, False)]
    return train(*split, chosen, prior)


def _scored(batches: Iterator[pa.RecordBatch], model: Model, text: int) -> Iterator[pa.RecordBatch]:
    cache = Cache(model.word, 200_000)
    for batch in batches:
        made = [model.score(t or "", cache) for t in batch.column(text).to_pylist()]
        yield batch.append_column("__score", pa.array(made, pa.float64()))


def _with_score(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """docs and a column __score."""
    rows, text = numbered(docs), docs.columns.index(text_col)
    made = rows.mapInArrow(lambda it: _scored(it, model, text), T.StructType([*rows.schema, T.StructField("__score", T.DoubleType())]))
    return made.toDF(*docs.columns, "__score")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, held_out, score, predicted (1 from a score of BAR).

    Null and empty texts score as texts without insults. Repeated rows and null ids (never held out) give rows like any
    other; other columns are ignored; no rows give no rows. Without any positive label all scores are near 0.
    """
    made = _with_score(docs.select(id_col, text_col), model, text_col)
    return made.select(id_col, held_out(id_col).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= BAR).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that score BAR or more, all columns as they were, whatever their names.

    Null and empty texts stay, repeated rows go or stay alike, an empty table gives an empty result.
    """
    return _with_score(docs, model, text_col).where(F.col("__score") < BAR).drop("__score")
