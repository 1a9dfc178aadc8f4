"""Clients, databases, collections and cursors."""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import BadValue, DuplicateKey, EngineError, NamespaceExists, NamespaceNotFound
from .operators import projection
from .operators.filters import compile_filter
from .operators.frame import Frame, utc_now
from .operators.stages import run_pipeline
from .operators.update import apply_update, update_rows, upsert_base
from .paths import quoted
from .plans.explain import explain_frame
from .plans.pipeline import parse_sort, whole
from .sources import documents, indexes
from .sources.store import Store
from .types import Typed, literal

BATCH = 101


@dataclass
class InsertResult:
    inserted_ids: list
    errors: list[dict] = field(default_factory=list)


@dataclass
class UpdateResult:
    matched_count: int
    modified_count: int
    upserted_id: object = None


@dataclass
class DeleteResult:
    deleted_count: int


def plain_value(value: object) -> object:
    """A row as a document."""
    if isinstance(value, Row):
        return {k: plain_value(v) for k, v in zip(value.__fields__, value)}
    if isinstance(value, (list, tuple)):
        return [plain_value(v) for v in value]
    if isinstance(value, dict):
        return {k: plain_value(v) for k, v in value.items()}
    return bytes(value) if isinstance(value, bytearray) else value


class Cursor:
    """A lazy result: a DataFrame, and an iterator of documents in batches."""

    def __init__(self, df: DataFrame, batch_size: int = BATCH) -> None:
        self.df, self.batch_size = df, batch_size if batch_size > 0 else BATCH
        self._rows: Iterator[Row] | None = None

    def __iter__(self) -> Iterator[dict]:
        while batch := self.next_batch():
            yield from batch

    def next_batch(self) -> list[dict]:
        if self._rows is None:
            self._rows = self.df.toLocalIterator()
        return [plain_value(r) for r in itertools.islice(self._rows, self.batch_size)]

    def to_list(self) -> list[dict]:
        return list(self)


class Find:
    """A find under construction: filter, then sort, skip, limit and projection, in this order."""

    def __init__(self, collection: Collection, query: dict) -> None:
        self._collection, self._query = collection, query
        self._sort: dict | None = None
        self._skip = self._limit = 0
        self._projection: dict | None = None
        self._batch, self._hint = BATCH, None

    def sort(self, keys: dict) -> Find:
        self._sort = keys
        return self

    def skip(self, n: int) -> Find:
        self._skip = whole(n, 0, "skip")
        return self

    def limit(self, n: int) -> Find:
        """No limit from 0 down."""
        self._limit = n
        return self

    def projection(self, spec: dict) -> Find:
        self._projection = spec
        return self

    def batch_size(self, n: int) -> Find:
        self._batch = n
        return self

    def hint(self, name: str | dict) -> Find:
        """An index by name or keys, or $natural. It is checked to exist; Spark plans the scan either way."""
        self._hint = name
        return self

    def frame(self) -> Frame:
        self._collection.check_hint(self._hint)
        frame = self._collection.frame()
        frame = frame.with_df(frame.df.where(compile_filter(self._query, frame.env())))
        order = parse_sort(self._sort) if self._sort else ()
        if order or self._skip or self._limit > 0:
            frame = frame.with_df(frame.df, order=order)
            frame = frame.with_df(frame.df.orderBy(*frame.sort_columns()))
        df = frame.df.offset(self._skip) if self._skip else frame.df
        frame = frame.with_df(df.limit(self._limit) if self._limit > 0 else df)
        return projection.apply(frame, self._projection) if self._projection else frame

    def to_df(self) -> DataFrame:
        return self.frame().df

    def run(self) -> Cursor:
        return Cursor(self.to_df(), self._batch)

    def explain(self) -> dict:
        return explain_frame(self.frame())


class Collection:
    """Documents of one schema: a DataFrame that is read only in place, or a stored dataset.

    id_col is the column that identifies documents; it answers to _id. plain declares that numbers hold no NaN and that
    a null is a missing field, which lets range conditions reach the scan. Writes to a stored collection make a new
    version; writes to one over a DataFrame change what this object reads.
    """

    def __init__(self, source: DataFrame | Store, id_col: str = "_id", plain: bool = False, database: Database | None = None, spark: SparkSession | None = None) -> None:
        self._store = source if isinstance(source, Store) else None
        self._df = None if self._store else source
        self._spark = spark or (self._store.spark if self._store else source.sparkSession)
        self.plain, self._database = plain, database
        meta = self._store.meta() if self._store else {}
        self.id_col = meta.get("id_col", id_col)
        self._indexes = [indexes.Index.of_meta(m) for m in meta.get("indexes", [])]

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, id_col: str = "_id", plain: bool = False) -> Collection:
        return cls(spark.read.parquet(path), id_col, plain)

    # -- reading

    def df(self) -> DataFrame:
        df = self._store.read() if self._store else self._df
        return df if df is not None else self._spark.createDataFrame([], T.StructType([T.StructField(self.id_col, T.StringType())]))

    def frame(self) -> Frame:
        read: dict[str, DataFrame | None] = {}

        def foreign(name: str) -> DataFrame | None:
            if name not in read:  # one snapshot for the whole operation
                other = self._database.get(name) if self._database else None
                read[name] = other.df() if other else None
            return read[name]

        return Frame(self.df(), self.id_col, plain=self.plain, now=utc_now(), foreign=foreign)

    def find(self, query: dict | None = None) -> Find:
        return Find(self, query or {})

    def find_one(self, query: dict | None = None) -> dict | None:
        return next(iter(self.find(query).limit(1).run()), None)

    def aggregate(self, pipeline: list[dict], batch_size: int = BATCH) -> Cursor:
        return Cursor(run_pipeline(self.frame(), pipeline).df, batch_size)

    def count_documents(self, query: dict | None = None) -> int:
        frame = self.frame()
        return frame.df.where(compile_filter(query or {}, frame.env())).count()

    def estimated_document_count(self) -> int:
        return self.df().count()

    def count(self, query: dict | None = None, skip: int = 0, limit: int = 0) -> int:
        """Skip first, then at most |limit| of the rest; no order is needed to count."""
        return max(0, min(self.count_documents(query) - whole(skip, 0, "skip"), abs(limit) or 2**63))

    def distinct_df(self, name: str, query: dict | None = None) -> DataFrame:
        """The distinct values at the path, in a column `value`; arrays on the way and at the end are spread."""
        if not name or name.startswith("$"):
            raise BadValue("distinct needs a field path")
        frame = self.frame()
        df = frame.df.where(compile_filter(query or {}, frame.env()))
        first, *rest = name.split(".")
        first = self.id_col if first == "_id" and "_id" not in df.columns else first
        if first not in df.columns:
            return df.select(F.lit(None).cast("string").alias("value")).where(F.lit(False))
        df, kind = df.select(quoted(first).alias("value")), df.schema[first].dataType
        for i, part in enumerate(rest):
            if isinstance(kind, T.ArrayType) and part.isdigit():
                df, kind = df.where(F.size("value") > int(part)).select(F.get("value", F.lit(int(part))).alias("value")), kind.elementType
                continue
            while isinstance(kind, T.ArrayType):
                df, kind = df.select(F.explode("value").alias("value")), kind.elementType
            if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
                return df.select(F.lit(None).cast("string").alias("value")).where(F.lit(False))
            df, kind = df.where("value is not null").select(F.col("value").getField(part).alias("value")), kind[part].dataType
        if isinstance(kind, T.ArrayType):
            null = F.when(F.col("value").isNull(), F.array(F.lit(None).cast(kind.elementType))).otherwise(F.col("value"))
            df = df.select(F.explode(null).alias("value"))
        if self.plain:
            df = df.where("value is not null")
        return df.distinct()

    def distinct(self, name: str, query: dict | None = None) -> list:
        return [plain_value(r["value"]) for r in self.distinct_df(name, query).toLocalIterator()]

    def explain(self, query: dict | None = None) -> dict:
        return self.find(query).explain()

    # -- writing

    def _meta(self) -> dict:
        return {"id_col": self.id_col, "indexes": [i.as_meta() for i in self._indexes]}

    def _put(self, df: DataFrame, new: DataFrame | None = None) -> None:
        """Make df what the collection holds; of inserts, new is what df has more, and alone is written if it can be."""
        frame = Frame(df, self.id_col, plain=self.plain)
        for index in self._indexes:
            if index.unique:
                indexes.check_unique(frame, index)
        by = [c for c in (self.id_col,) if c in df.columns]
        if not self._store:
            self._df = df
        elif new is not None and (known := self._store.read()) is not None and _alike(known.schema, new.schema):
            self._store.append(new, self._meta(), by)
        else:
            self._store.write(df, self._meta(), by)

    def insert_one(self, doc: dict) -> InsertResult:
        return self.insert_many([doc])

    def insert_many(self, docs: list[dict], ordered: bool = True) -> InsertResult:
        """Insert documents; an error stops those behind it if ordered, and is reported with the rest done if not."""
        made = [d if self.id_col in d else {self.id_col: documents.new_id()} | d for d in docs]
        frame = self.frame()
        there = {r[0] for r in frame.df.where(compile_filter({self.id_col: {"$in": [d[self.id_col] for d in made]}}, frame.env())).select(quoted(self.id_col)).toLocalIterator()} if made else set()
        good, errors = [], []
        unique = [i for i in self._indexes if i.unique]
        for at, doc in enumerate(made):
            try:
                documents.validate(doc)
                key = doc[self.id_col]
                if key in there:
                    raise DuplicateKey(f"duplicate key of _id: {key!r}")
                if unique:
                    trial = Frame(self._joined([*good, doc]), self.id_col, plain=self.plain)
                    for index in unique:
                        indexes.check_unique(trial, index)
                there.add(key)
                good.append(doc)
            except EngineError as e:
                errors.append({"index": at, "code": e.code, "errmsg": str(e)})
                if ordered:
                    break
        if good:
            known = self._store.read() if self._store else None
            self._put(self._joined(good), documents.to_frame(self._spark, good, known.schema) if known is not None else None)
        if errors and len(docs) == 1:
            raise (DuplicateKey if errors[0]["code"] == DuplicateKey.code else EngineError)(errors[0]["errmsg"], errors[0]["code"])
        return InsertResult([d[self.id_col] for d in good], errors)

    def _joined(self, docs: list[dict]) -> DataFrame:
        known = self.df() if self._store is None or self._store.version() else None
        if known is None or known.columns == [self.id_col] and known.isEmpty():
            return documents.to_frame(self._spark, docs)
        new = documents.to_frame(self._spark, docs, known.schema)
        wide = known.select(*[_as(known, f).alias(f.name) for f in new.schema])
        return wide.unionByName(new)

    def insert_df(self, new: DataFrame) -> None:
        """Append a DataFrame of documents; an identifier that is there, or twice in it, raises."""
        key = quoted(self.id_col)
        if new.groupBy(key).count().where("count > 1").limit(1).count() or new.join(self.df().select(key), self.id_col, "left_semi").limit(1).count():
            raise DuplicateKey("duplicate key of _id")
        known = self.df()
        self._put(new if known.columns == [self.id_col] and known.isEmpty() else known.unionByName(new, allowMissingColumns=True), new)

    def _first(self, query: dict, sort: dict | None = None) -> dict | None:
        found = self.find(query).limit(1)
        return next(iter((found.sort(sort) if sort else found).run()), None)

    def _is(self, key: object) -> Column:
        return quoted(self.id_col).eqNullSafe(literal(key).col)

    def update_many(self, query: dict, update: dict | list, upsert: bool = False, array_filters: list[dict] | None = None) -> UpdateResult:
        frame = self.frame()
        return self._update(frame, compile_filter(query, frame.env()), query, update, upsert, array_filters)

    def update_one(self, query: dict, update: dict | list, upsert: bool = False, array_filters: list[dict] | None = None) -> UpdateResult:
        one = self._first(query)
        return self._update(self.frame(), self._is(one[self.id_col]) if one else F.lit(False), query, update, upsert, array_filters)

    def _update(self, frame: Frame, match: Column, query: dict, update: dict | list, upsert: bool, array_filters: list[dict] | None) -> UpdateResult:
        matched = frame.df.where(match).count()
        if not matched:
            apply_update(frame, update, query, array_filters)  # errors show whether or not a document matches
            return UpdateResult(0, 0, self._upsert(query, update, array_filters) if upsert else None)
        done, changed = update_rows(frame, match, update, query, array_filters)
        modified = done.df.where(changed).count()
        if modified:
            self._put(done.df.drop("__changed"))
        return UpdateResult(matched, modified)

    def _upsert(self, query: dict, update: dict | list, array_filters: list[dict] | None) -> object:
        base = upsert_base(query)
        base = {self.id_col if k == "_id" else k: v for k, v in base.items()}
        if self.id_col not in base:
            fixed = update.get("$set", {}) | update.get("$setOnInsert", {}) if isinstance(update, dict) else {}
            base = {self.id_col: fixed.get(self.id_col, fixed.get("_id", documents.new_id()))} | base
        row = documents.to_frame(self._spark, [base])
        done = apply_update(Frame(row, self.id_col, plain=self.plain), update, query, array_filters, inserting=True)
        doc = {k: v for k, v in plain_value(done.df.first()).items()}
        self.insert_one(doc)
        return doc[self.id_col]

    def replace_one(self, query: dict, doc: dict, upsert: bool = False) -> UpdateResult:
        if any(k.startswith("$") for k in doc):
            raise BadValue("a replacement has no operators")
        given = {self.id_col if k == "_id" else k: v for k, v in doc.items()}
        documents.validate(given)
        one = self._first(query)
        if one is None:
            if not upsert:
                return UpdateResult(0, 0)
            key = given.get(self.id_col, upsert_base(query).get("_id", upsert_base(query).get(self.id_col)))
            new = {self.id_col: key if key is not None else documents.new_id()} | given
            self.insert_one(new)
            return UpdateResult(0, 0, new[self.id_col])
        if given.setdefault(self.id_col, one[self.id_col]) != one[self.id_col]:
            raise BadValue("the identifier can't be changed")
        if {k: v for k, v in one.items() if v is not None} == given:
            return UpdateResult(1, 0)
        known = self.df()
        new = documents.to_frame(self._spark, [given], known.schema)
        rest = known.where(~self._is(one[self.id_col]))
        self._put(rest.select(*[_as(rest, f).alias(f.name) for f in new.schema]).unionByName(new))
        return UpdateResult(1, 1)

    def delete_many(self, query: dict) -> DeleteResult:
        frame = self.frame()
        return self._delete(F.coalesce(compile_filter(query, frame.env()), F.lit(False)))

    def delete_one(self, query: dict) -> DeleteResult:
        one = self._first(query)
        return self._delete(self._is(one[self.id_col])) if one else DeleteResult(0)

    def _delete(self, match: Column) -> DeleteResult:
        df = self.df()
        n = df.where(match).count()
        if n:
            self._put(df.where(~match))
        return DeleteResult(n)

    def find_one_and_update(self, query: dict, update: dict | list, sort: dict | None = None, after: bool = False, upsert: bool = False, array_filters: list[dict] | None = None) -> dict | None:
        one = self._first(query, sort)
        if one is None:
            if not upsert:
                return None
            key = self._upsert(query, update, array_filters)
        else:
            key = one[self.id_col]
            self._update(self.frame(), self._is(key), query, update, False, array_filters)
        return self.find_one({self.id_col: key}) if after else one

    def find_one_and_replace(self, query: dict, doc: dict, sort: dict | None = None, after: bool = False, upsert: bool = False) -> dict | None:
        one = self._first(query, sort)
        result = self.replace_one({self.id_col: one[self.id_col]} if one else query, doc, upsert)
        key = one[self.id_col] if one else result.upserted_id
        return one if not after else self.find_one({self.id_col: key}) if key is not None else None

    def find_one_and_delete(self, query: dict, sort: dict | None = None) -> dict | None:
        one = self._first(query, sort)
        if one is not None:
            self._delete(self._is(one[self.id_col]))
        return one

    # -- indexes

    def create_index(self, keys: dict, **options: object) -> str:
        """Declare an index: name, unique, sparse, partial (a filter), expire_after (seconds)."""
        index = indexes.make(keys, self.id_col, **options)
        for known in self._indexes:
            if known == index:
                return index.name
            if known.name == index.name or known.keys == index.keys and known.partial == index.partial:
                raise EngineError(f"an index {known.name} is there with other options", 86)
        if index.unique:
            indexes.check_unique(self.frame(), index)
        self._indexes.append(index)
        self._annotate()
        return index.name

    def drop_index(self, name: str) -> None:
        if name == "_id_":
            raise BadValue("the index of the identifier stays")
        if name != "*" and all(i.name != name for i in self._indexes):
            raise EngineError(f"no index {name}", 27)
        self._indexes = [i for i in self._indexes if name != "*" and i.name != name]
        self._annotate()

    def list_indexes(self) -> list[dict]:
        return [{"v": 2, "key": {"_id": 1}, "name": "_id_"}, *[i.info() for i in self._indexes]]

    def _annotate(self) -> None:
        if self._store:
            self._store.annotate(self._meta())

    def check_hint(self, hint: str | dict | None) -> None:
        known = [({"_id": 1}, "_id_"), ({self.id_col: 1}, "_id_"), *[(dict(i.keys), i.name) for i in self._indexes]]
        if hint is not None and hint not in ("$natural", {"$natural": 1}, {"$natural": -1}) and all(hint not in (keys, name) for keys, name in known):
            raise BadValue(f"no index for the hint {hint!r}")

    def sweep_expired(self, now: dt.datetime | None = None) -> int:
        """Delete the documents whose time has run out, and say how many."""
        frame = self.frame()
        match = F.lit(False)
        for index in self._indexes:
            if index.expire_after is not None:
                match = match | indexes.expired(frame, index, now or frame.now)
        return self._delete(match).deleted_count

    def backup(self, path: str) -> None:
        self.df().write.mode("overwrite").parquet(path)


def _alike(a: T.StructType, b: T.StructType) -> bool:
    """Whether documents of one schema can lie beside those of the other: same names and types."""
    return {f.name: f.dataType.simpleString() for f in a} == {f.name: f.dataType.simpleString() for f in b}


def _as(df: DataFrame, f: T.StructField) -> Column:
    from .types import cast

    return cast(Typed(quoted(f.name), df.schema[f.name].dataType), f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)


class Database:
    """Collections by name: stored below a folder, or registered DataFrames."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None) -> None:
        self.spark, self.name, self.root = spark, name, root
        self._held: dict[str, Collection] = {}

    def _path(self, name: str) -> str:
        if not name or "$" in name or "\0" in name or "/" in name:
            raise BadValue(f"{name!r} is no collection name")
        if self.root is None:
            raise NamespaceNotFound(f"no collection {name}, and no folder to make one in")
        return f"{self.root.rstrip('/')}/{self.name}/{name}"

    def register(self, name: str, df: DataFrame, id_col: str = "_id", plain: bool = False) -> Collection:
        self._held[name] = Collection(df, id_col, plain, self)
        return self._held[name]

    def get(self, name: str) -> Collection | None:
        """The collection if there is one."""
        if name not in self._held:
            if self.root is None or not Store(self.spark, self._path(name)).version():
                return None
            self._held[name] = Collection(Store(self.spark, self._path(name)), database=self)
        return self._held[name]

    def collection(self, name: str, id_col: str = "_id") -> Collection:
        """The collection, made by its first write if there is none."""
        if (known := self.get(name)) is None:
            known = Collection(Store(self.spark, self._path(name)), id_col, database=self) if self.root is not None else Collection(self.spark.createDataFrame([], f"`{id_col}` string"), id_col, database=self)
            self._held[name] = known
        return known

    __getitem__ = collection

    def create_collection(self, name: str, id_col: str = "_id") -> Collection:
        if self.get(name) is not None:
            raise NamespaceExists(f"collection {name} is there")
        made = self.collection(name, id_col)
        made._annotate()
        return made

    def drop_collection(self, name: str) -> None:
        held = self._held.pop(name, None)
        if held is not None and held._store:
            held._store.drop()
        elif held is None and self.root is not None:
            Store(self.spark, self._path(name)).drop()

    def list_collections(self) -> list[str]:
        names = set(self._held)
        if self.root is not None:
            at = Store(self.spark, f"{self.root.rstrip('/')}/{self.name}")
            if at._fs().exists(at._at()):
                names |= {f.getPath().getName() for f in at._fs().listStatus(at._at())}
        return sorted(names)

    def checkpoint(self, keep: int = 1) -> None:
        """Delete the versions of stored collections that newer ones have replaced, but for the last `keep`."""
        for name in self.list_collections():
            held = self.get(name)
            if held is not None and held._store:
                held._store.vacuum(keep)

    def backup(self, path: str) -> None:
        """Copy every collection's documents below a folder."""
        for name in self.list_collections():
            if (held := self.get(name)) is not None:
                held.backup(f"{path.rstrip('/')}/{name}")

    def drop(self) -> None:
        for name in self.list_collections():
            self.drop_collection(name)

    def run_command(self, command: dict) -> dict:
        from .commands import run

        return run(self, command)


class Client:
    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root
        self._databases: dict[str, Database] = {}
        self.cursors: dict[int, tuple[Cursor, str, float]] = {}

    def database(self, name: str) -> Database:
        if name not in self._databases:
            self._databases[name] = Database(self.spark, name, self.root)
            self._databases[name].client = self
        return self._databases[name]

    __getitem__ = database

    def list_databases(self) -> list[str]:
        names = {n for n, d in self._databases.items() if d.list_collections()}
        if self.root is not None:
            at = Store(self.spark, self.root)
            if at._fs().exists(at._at()):
                names |= {f.getPath().getName() for f in at._fs().listStatus(at._at())}
        return sorted(names)

    def drop_database(self, name: str) -> None:
        self.database(name).drop()
        self._databases.pop(name, None)

    def close(self) -> None:
        """Forget open cursors and handles; every commit is on disk already."""
        self.cursors.clear()
        self._databases.clear()
