"""Helpers that the training-data operators share: scratch tables, skew-safe joins, graph components."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: At most this many groups can each hold over 1/HOT_GROUPS of the rows, so a table of them is safe to broadcast.
HOT_GROUPS = 1024

_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    named, warehouse = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir")
    if not named and warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        warnings.warn(f"spark.checkpoint.dir is unset, so scratch tables go to {warehouse}, which executors must share", stacklevel=2)
    return (named or warehouse).rstrip("/")


def write(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written once to the shared folder and read back, and where it lies; what is still there when the driver's JVM
    ends is deleted then."""
    path = f"{scratch_root(df.sparkSession)}/folio-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _file(df.sparkSession, path)
    fs.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame) -> DataFrame:
    """df as a scratch table that release() deletes.

    This cuts the lineage, survives the loss of any executor, and, unlike checkpoint(), runs the plan once.
    """
    back, path = write(df)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return back


def _file(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _file(spark, path)
    fs.delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when what was built on them has been written."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_key(column: str = "doc_id") -> Column:
    """An identifier as a join key that is never null."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: names of any kind then pass through Python functions over rows."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's content, by which one of several rows is picked alike in every run; equal rows are equal."""
    plain = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("bigint")


def slices(batch: pa.RecordBatch, column: int | str, most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows, and so many bytes of text unless one text alone has more."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8")
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, min(at + most_rows, int(np.searchsorted(total, before + most_bytes, "right"))))
        yield batch.slice(at, end - at)
        at = end


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int | None = None) -> DataFrame:
    """rows LEFT JOIN groups on keys, where one key may hold a large share of all rows.

    groups has one row a key and in `size` how many rows hold it. Groups with over 1/HOT_GROUPS of the rows number
    fewer than HOT_GROUPS by counting, so they are broadcast; what the others hold is dealt out by key, and no key
    of theirs is large. Every row meets its group in one of the two joins. total is the sum of size, if it is known.
    """
    if total is None:
        total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    bar = max(1.0, total / HOT_GROUPS)
    values = [c for c in groups.columns if c not in keys]
    at = [f"__k{i}" for i in range(len(keys))]
    hot = groups.where(F.col(size) > bar).select(*keys, F.struct(*values).alias("__hot"))
    cold = groups.where(F.col(size) <= bar).select(*keys, F.struct(*values).alias("__cold"))
    tried = rows.join(F.broadcast(hot), keys, "left")
    far = cold.select(*[F.col(k).alias(x) for k, x in zip(keys, at)], "__cold")
    met = tried.where("__hot is not null").select(*rows.columns, F.col("__hot").alias("__got"))
    rest = tried.where("__hot is null").drop("__hot").withColumns({x: F.col(k) for k, x in zip(keys, at)}).join(far, at, "left").select(*rows.columns, F.col("__cold").alias("__got"))
    return met.unionByName(rest).select(*rows.columns, *[F.col(f"__got.{v}").alias(v) for v in values])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long) as (node, component), component being the smallest node.

    Alternates the large-star and small-star steps on the distributed edge list until it stands still. Each step's
    edges go to a scratch table; the driver sees a count and a checksum alone. Nodes without edges don't appear.
    """

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = summary(current)
    while seen[0]:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        # A node may have a large share of all edges: it is the smallest of its group, or of many prefixes.
        met = join_groups(both, least, ["a"], "n", 2 * seen[0])
        large = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), "a", "m")
        after = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        current = materialise(after)
        now = summary(current)
        if now == seen:
            break
        seen = now
    label = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label.union(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
