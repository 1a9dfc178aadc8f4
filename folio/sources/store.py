"""Collections as immutable Parquet versions.

A collection's folder holds data/<n> for what each version added and meta/<n>.json, which names the parts of its data
and makes it current. A write makes the next version's part, then creates its meta file, which fails if another writer
has: the loser's version is never seen. An insert adds a part; updates and deletes replace all parts by one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_class = spark._jvm.org.apache.hadoop.fs

    def _at(self, *parts: object):
        return self._fs_class.Path("/".join(map(str, (self.path, *parts))))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version, 0 if there is none."""
        fs, where = self._fs(), self._at("meta")
        if not fs.exists(where):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def meta(self, version: int | None = None) -> dict:
        n = version or self.version()
        if not n:
            return {}
        stream = self._fs().open(self._at("meta", f"{n}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        n = version or self.version()
        data = self.meta(n).get("data") if n else None
        return self.spark.read.parquet(*[f"{self.path}/data/{part}" for part in data]) if data else None

    #: An insert that would make more parts than this joins them.
    PARTS = 64

    def write(self, df: DataFrame, meta: dict, by: list[str] | None = None) -> None:
        """Write the next version, sorted within files by the columns that reads look up, so that scans can skip."""
        self._write(df, meta, by, [])

    def append(self, new: DataFrame, meta: dict, by: list[str] | None = None) -> None:
        """The next version: what there is, and new documents of the same schema, which alone are written."""
        known = self.meta().get("data") or []
        if len(known) >= self.PARTS:
            self._write(self.read().unionByName(new), meta, by, [])
        else:
            self._write(new, meta, by, known)

    def _write(self, df: DataFrame, meta: dict, by: list[str] | None, known: list[int]) -> None:
        n = self.version() + 1
        (df.sortWithinPartitions(*by) if by else df).write.mode("overwrite").parquet(f"{self.path}/data/{n}")
        self._commit(n, meta | {"data": [*known, n]})

    def annotate(self, meta: dict) -> None:
        """A version of the same data with other metadata."""
        n = self.version() + 1
        self._commit(n, meta | {"data": self.meta().get("data")})

    def _commit(self, n: int, meta: dict) -> None:
        try:
            stream = self._fs().create(self._at("meta", f"{n}.json"), False)
        except Exception as e:
            raise EngineError(f"another writer has made version {n}") from e
        stream.write(bytearray(json.dumps(meta).encode()))
        stream.close()

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last `keep` versions."""
        last, fs = self.version(), self._fs()
        held = {part for n in range(max(1, last - keep + 1), last + 1) for part in self.meta(n).get("data") or []}
        for kind, stays in (("data", lambda name: int(name) in held), ("meta", lambda name: int(name[:-5]) > last - keep)):
            where = self._at(kind)
            for f in fs.listStatus(where) if fs.exists(where) else []:
                if (name := f.getPath().getName()).removesuffix(".json").isdigit() and not stays(name):
                    fs.delete(f.getPath(), True)

    def drop(self) -> None:
        self._fs().delete(self._at(), True)
