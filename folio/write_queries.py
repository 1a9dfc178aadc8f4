"""Registered queries of writes, cursors, indexes and commands, each with the SQL that it must agree with.

Writes change what the collection reads within one call of a query; the tables' files are never touched.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .client import Client, Collection
from .errors import EngineError
from .queries import IDS, Tables, query
from .sources import documents

Rows = Callable[[Tables], list[tuple]]


def rows(name: str, sql: str, schema: str, make: Rows) -> None:
    """A query whose few rows the client's own results are."""
    query(name, sql, lambda t: t.spark.createDataFrame(make(t), schema))


def left(name: str, sql: str, table: str, change: Callable[[Collection], object], columns: list[str] | None = None) -> None:
    """What a table holds after a change."""

    def make(t: Tables) -> DataFrame:
        change(t[table])
        return t[table].df().select(*columns) if columns else t[table].df()

    query(name, sql, make)


def refused(act: Callable[[], object]) -> int:
    """The code of the error that an act raises, 0 if it does not."""
    try:
        act()
    except EngineError as e:
        return e.code
    return 0


# -- reads

rows("find_by_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (7, 11)", "c_custkey long, c_name string", lambda t: [(d["c_custkey"], d["c_name"]) for d in [t["customer"].find_one({"_id": 7}), *t["customer"].find({"_id": {"$in": [11, -5]}}).run()]])
query("find_by_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (5, 9, 1000, 14999)", lambda t: t["orders"].find({"_id": {"$in": [5, 9, 1000, 14999, -1]}}).projection({"o_totalprice": 1}).to_df())
rows("find_one_of_many", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 1", "c_custkey long, c_name string", lambda t: [(d["c_custkey"], d["c_name"]) for d in [t["customer"].find_one({"c_nationkey": 7})]])
query("find_natural_order", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 15 OFFSET 4", lambda t: t["part"].find().skip(4).limit(15).projection({"p_name": 1}).to_df())


def _indexed(t: Tables) -> Collection:
    t["customer"].create_index({"c_acctbal": 1}, name="balance")
    return t["customer"]


query("find_indexed_range", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 1000 AND 2000", lambda t: _indexed(t).find({"c_acctbal": {"$gte": 1000, "$lte": 2000}}).to_df().select("c_custkey"))
query("find_hinted", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000", lambda t: _indexed(t).find({"c_acctbal": {"$gt": 9000}}).hint("balance").projection({"c_acctbal": 1}).to_df())
rows("hint_of_no_index", "SELECT 2 AS code", "code int", lambda t: [(refused(lambda: t["customer"].find({}).hint("none").to_df()),)])
rows("count_documents", "SELECT count(*) FILTER (o_orderstatus = 'F') AS some, count(*) AS every, 25::BIGINT AS page FROM orders", "some long, every long, page long", lambda t: [(t["orders"].count_documents({"o_orderstatus": "F"}), t["orders"].estimated_document_count(), t["orders"].count({"o_orderstatus": "F"}, skip=3, limit=25))])
rows("count_command", "SELECT greatest(0, count(*) - 10) AS n FROM customer WHERE c_acctbal < 0", "n long", lambda t: [(t.run_command({"count": "customer", "query": {"c_acctbal": {"$lt": 0}}, "skip": 10})["n"],)])
rows("distinct_command", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_nationkey < 5", "value string", lambda t: [(v,) for v in t.run_command({"distinct": "customer", "key": "c_mktsegment", "query": {"c_nationkey": {"$lt": 5}}})["values"]])
rows("explain_pushdown", "SELECT true AS filters, true AS sorted", "filters boolean, sorted boolean", lambda t: [(lambda e: (any("c_nationkey" in str(f) for f in e["queryPlanner"]["pushedFilters"]), "Sort" in e["sparkPlan"]))(t.run_command({"explain": {"find": "customer", "filter": {"c_nationkey": {"$gt": 20}}, "sort": {"c_acctbal": -1}}}))])


def _paged(t: Tables, command: dict) -> list[dict]:
    reply = t.run_command(command)
    found, cursor = reply["cursor"]["firstBatch"], reply["cursor"]["id"]
    while cursor:
        reply = t.run_command({"getMore": cursor, "collection": "x", "batchSize": 40})
        found, cursor = found + reply["cursor"]["nextBatch"], reply["cursor"]["id"]
    return found


rows("find_command_get_more", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3", "c_custkey long, c_name string", lambda t: [(d["c_custkey"], d["c_name"]) for d in _paged(t, {"find": "customer", "filter": {"c_nationkey": 3}, "sort": {"c_acctbal": 1}, "projection": {"c_name": 1}, "batchSize": 7})])
rows("aggregate_command", "SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1", "k string, n long", lambda t: [(d["_id"], d["n"]) for d in _paged(t, {"aggregate": "customer", "pipeline": [{"$group": {"_id": "$c_mktsegment", "n": {"$sum": 1}}}], "cursor": {"batchSize": 2}})])


def _killed(t: Tables) -> list[tuple]:
    first = t.run_command({"find": "customer", "batchSize": 3})["cursor"]["id"]
    reply = t.run_command({"killCursors": "customer", "cursors": [first, -9]})
    return [(reply["cursorsKilled"] == [first], reply["cursorsNotFound"] == [-9], int(t.run_command({"getMore": first, "collection": "customer"})["code"]))]


rows("kill_cursors", "SELECT true AS killed, true AS unknown, 43 AS code", "killed boolean, unknown boolean, code int", _killed)

# -- writes


def nation(key: int, name: str, region: int = 1) -> dict:
    return {"n_nationkey": key, "n_name": name, "n_regionkey": region}


left("insert_one", "SELECT * FROM nation UNION ALL SELECT 900, 'NEW', 1", "nation", lambda c: c.insert_one(nation(900, "NEW")))
left("insert_many_ordered", "SELECT * FROM nation UNION ALL SELECT 900, 'A', 1", "nation", lambda c: c.insert_many([nation(900, "A"), nation(3, "TWICE"), nation(901, "B")]))
left("insert_many_unordered", "SELECT * FROM nation UNION ALL SELECT * FROM (VALUES (900, 'A', 1), (901, 'B', 2)) t", "nation", lambda c: c.insert_many([nation(900, "A"), nation(3, "TWICE"), nation(901, "B", 2), nation(900, "AGAIN")], ordered=False))
left("insert_dataframe", "SELECT * FROM supplier UNION ALL SELECT s_suppkey + 100000, s_name, s_nationkey, s_acctbal FROM supplier", "supplier", lambda c: c.insert_df(c.df().withColumn("s_suppkey", F.col("s_suppkey") + 100_000)))
left("replace_one", "SELECT CASE WHEN n_nationkey = 4 THEN 4 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_nationkey = 4 THEN 'FOUR' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 4 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation", "nation", lambda c: c.replace_one({"n_nationkey": 4}, {"n_name": "FOUR"}))
left("replace_one_upsert", "SELECT * FROM nation UNION ALL SELECT 77, 'SEVEN', NULL", "nation", lambda c: c.replace_one({"n_nationkey": 77}, {"n_name": "SEVEN"}, upsert=True))
left("update_one", "SELECT n_nationkey, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2) THEN 'FIRST' ELSE n_name END AS n_name, n_regionkey FROM nation", "nation", lambda c: c.update_one({"n_regionkey": 2}, {"$set": {"n_name": "FIRST"}}))
left("update_many", "SELECT n_nationkey, n_name, n_regionkey + CASE WHEN n_nationkey >= 10 THEN 100 ELSE 0 END AS n_regionkey FROM nation", "nation", lambda c: c.update_many({"n_nationkey": {"$gte": 10}}, {"$inc": {"n_regionkey": 100}}))
left("update_upsert_base", "SELECT *, NULL AS tag FROM nation UNION ALL SELECT 800, 'BASE', 3, 'set'", "nation", lambda c: c.update_one({"n_nationkey": 800, "n_name": "BASE", "n_regionkey": {"$gt": 1}}, {"$set": {"n_regionkey": 3}, "$setOnInsert": {"tag": "set"}}, upsert=True))
left("update_set_on_insert_skipped", "SELECT n_nationkey, CASE WHEN n_nationkey = 8 THEN 'EIGHT' ELSE n_name END AS n_name, n_regionkey FROM nation", "nation", lambda c: c.update_one({"n_nationkey": 8}, {"$set": {"n_name": "EIGHT"}, "$setOnInsert": {"n_regionkey": 99}}, upsert=True))
left("delete_one", "SELECT * FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 3)", "nation", lambda c: c.delete_one({"n_regionkey": 3}))
rows("update_counts", "SELECT count(*) FILTER (n_regionkey = 1) AS matched, count(*) FILTER (n_regionkey = 1 AND n_nationkey > 6) AS modified, count(*) FILTER (n_regionkey = 2) AS deleted FROM nation", "matched long, modified long, deleted long", lambda t: [(lambda r: (r.matched_count, r.modified_count, t["nation"].delete_many({"n_regionkey": 2}).deleted_count))(t["nation"].update_many({"n_regionkey": 1}, {"$max": {"n_nationkey": 0}} if False else [{"$set": {"n_name": {"$cond": [{"$gt": ["$n_nationkey", 6]}, "BIG", "$n_name"]}}}]))])
rows("replacement_in_update_refused", "SELECT 2 AS one, 2 AS many", "one int, many int", lambda t: [tuple(refused(lambda f=f: f({"n_nationkey": 1}, {"n_name": "X"})) for f in (t["nation"].update_one, t["nation"].update_many))])


def _modified(t: Tables) -> list[tuple]:
    c = t["nation"]
    before = c.find_one_and_update({"n_regionkey": 1}, {"$set": {"n_name": "U"}}, sort={"n_nationkey": -1})
    after = c.find_one_and_update({"n_nationkey": before["n_nationkey"]}, {"$inc": {"n_regionkey": 5}}, after=True)
    made = c.find_one_and_update({"n_nationkey": 500}, {"$set": {"n_name": "M"}}, after=True, upsert=True)
    replaced = c.find_one_and_replace({"n_nationkey": 500}, {"n_name": "R"}, after=True)
    gone = c.find_one_and_delete({}, sort={"n_nationkey": -1})
    return [(step, d["n_nationkey"], d["n_name"]) for step, d in (("before", before), ("after", after), ("made", made), ("replaced", replaced), ("gone", gone))] + [("rest", c.count_documents(), "")]


rows("find_and_modify", "SELECT 'before' AS step, max(n_nationkey) AS k, arg_max(n_name, n_nationkey) AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'after', max(n_nationkey), 'U' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT * FROM (VALUES ('made', 500, 'M'), ('replaced', 500, 'R'), ('gone', 500, 'R')) t UNION ALL SELECT 'rest', count(*), '' FROM nation", "step string, k long, name string", _modified)


def _commands(t: Tables) -> list[tuple]:
    run = t.run_command
    out = [
        ("insert", run({"insert": "nation", "documents": [nation(700, "I"), nation(701, "J")]})["n"]),
        ("insert twice", run({"insert": "nation", "documents": [nation(700, "I")]})["writeErrors"][0]["code"]),
        ("update", run({"update": "nation", "updates": [{"q": {"n_nationkey": {"$gte": 700}}, "u": {"$set": {"n_regionkey": 9}}, "multi": True}]})["nModified"]),
        ("upsert", len(run({"update": "nation", "updates": [{"q": {"n_nationkey": 702}, "u": {"$set": {"n_name": "K"}}, "upsert": True}]})["upserted"])),
        ("find and modify", run({"findAndModify": "nation", "query": {"n_nationkey": 701}, "update": {"$set": {"n_name": "L"}}, "new": True})["value"]["n_nationkey"]),
        ("delete", run({"delete": "nation", "deletes": [{"q": {"n_nationkey": {"$gte": 701}}, "limit": 0}]})["n"]),
        ("left", run({"count": "nation"})["n"]),
        ("unknown", run({"nothing": 1})["code"]),
        ("bad filter", run({"find": "nation", "filter": {"n_name": {"$near": 1}}})["ok"]),
        ("ping", run({"ping": 1})["ok"]),
        ("hello", run({"hello": 1})["maxBsonObjectSize"]),
        ("create", run({"create": "made"})["ok"]),
        ("create twice", run({"create": "made"})["code"]),
        ("list", sum(d["name"] == "made" for d in run({"listCollections": 1})["cursor"]["firstBatch"])),
        ("drop", run({"drop": "made"})["ok"]),
        ("drop again", run({"drop": "made"})["code"]),
        ("create index", run({"createIndexes": "customer", "indexes": [{"key": {"c_name": 1}, "name": "n", "unique": True}, {"key": {"c_acctbal": -1, "c_nationkey": 1}}]})["numIndexesAfter"]),
        ("drop index", run({"dropIndexes": "customer", "index": "n"})["nIndexesWas"]),
        ("list indexes", len(run({"listIndexes": "customer"})["cursor"]["firstBatch"])),
    ]
    return [(name, int(n)) for name, n in out]


rows("commands", "SELECT * FROM (VALUES ('insert', 2), ('insert twice', 11000), ('update', 2), ('upsert', 1), ('find and modify', 701), ('delete', 2), ('unknown', 59), ('bad filter', 0), ('ping', 1), ('hello', 16777216), ('create', 1), ('create twice', 48), ('list', 1), ('drop', 1), ('drop again', 26), ('create index', 3), ('drop index', 3), ('list indexes', 2)) t(command, n) UNION ALL SELECT 'left', count(*) + 1 FROM nation", "command string, n long", _commands)


def _unsupported(t: Tables) -> list[tuple]:
    c = t["nation"]
    acts = {
        "filter": lambda: c.find({"n_name": {"$near": 1}}).to_df(), "top": lambda: c.find({"$where": "1"}).to_df(), "stage": lambda: c.aggregate([{"$facet": {}}]), "expression": lambda: c.aggregate([{"$project": {"x": {"$nothing": 1}}}]),
        "accumulator": lambda: c.aggregate([{"$group": {"_id": 1, "x": {"$nothing": 1}}}]), "update": lambda: c.update_many({}, {"$nothing": {"x": 1}}), "text index": lambda: c.create_index({"n_name": "text"}), "empty index": lambda: c.create_index({}),
    }
    return [(name, refused(act) != 0) for name, act in acts.items()]


rows("unsupported_is_refused", "SELECT unnest(['filter', 'top', 'stage', 'expression', 'accumulator', 'update', 'text index', 'empty index']) AS kind, true AS refused", "kind string, refused boolean", _unsupported)

# -- indexes


def _unique(t: Tables) -> list[tuple]:
    c = t["customer"]
    c.create_index({"c_name": 1}, unique=True)
    half = {"c_custkey": 10**6, "c_name": "Customer#000000000", "c_nationkey": 1, "c_acctbal": 1.0, "c_mktsegment": "X"}
    tries = {
        "unique": lambda: c.insert_one(half), "unique other": lambda: c.insert_one(half | {"c_name": "other"}), "not unique": lambda: c.create_index({"c_nationkey": 1}, unique=True),
        "compound": lambda: c.create_index({"c_nationkey": 1, "c_custkey": 1}, unique=True), "partial": lambda: c.create_index({"c_mktsegment": 1}, unique=True, partial={"c_mktsegment": "X"}),
        "partial twice": lambda: c.insert_one(half | {"c_custkey": 10**6 + 1, "c_name": "third"}), "other options": lambda: c.create_index({"c_name": 1}, unique=False), "same again": lambda: c.create_index({"c_name": 1}, unique=True),
    }
    return [(name, refused(act)) for name, act in tries.items()]


rows("unique_indexes", "SELECT * FROM (VALUES ('unique', 11000), ('unique other', 0), ('compound', 0), ('partial', 0), ('partial twice', 11000), ('other options', 86), ('same again', 0)) t(act, code) UNION ALL SELECT 'not unique', CASE WHEN count(*) > count(DISTINCT c_nationkey) THEN 11000 ELSE 0 END FROM customer", "act string, code int", _unique)


def _sparse(t: Tables) -> list[tuple]:
    df = t["nation"].df().select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("half"), F.array(F.lit("t"), F.col("n_name")).alias("tags"), F.array("n_name", "n_name").alias("own"))
    make = lambda **more: Collection(df, "n_nationkey", plain=True).create_index(more.pop("keys"), unique=True, **more)
    acts = {"sparse": {"keys": {"half": 1}, "sparse": True}, "nulls": {"keys": {"half": 1}}, "shared element": {"keys": {"tags": 1}}, "own elements": {"keys": {"own": 1}}, "two arrays": {"keys": {"own": 1, "tags": 1}}, "sparse partial": {"keys": {"half": 1}, "sparse": True, "partial": {"half": "x"}}}
    return [(name, refused(lambda m=more: make(**m))) for name, more in acts.items()]


rows("sparse_and_multikey_indexes", "SELECT * FROM (VALUES ('sparse', 0), ('nulls', 11000), ('shared element', 11000), ('own elements', 0), ('two arrays', 67), ('sparse partial', 67)) t(act, code)", "act string, code int", _sparse)


def _listed(t: Tables) -> list[tuple]:
    c = t["customer"]
    c.create_index({"c_nationkey": 1, "c_acctbal": -1})
    c.create_index({"c_name": 1}, name="by name", sparse=True)
    c.create_index({"c_mktsegment": 1})
    c.drop_index("c_mktsegment_1")
    return [(i["name"], ",".join(f"{k}:{d}" for k, d in i["key"].items()), i["v"], i.get("sparse", False)) for i in c.list_indexes()]


rows("list_indexes", "SELECT * FROM (VALUES ('_id_', '_id:1', 2, false), ('c_nationkey_1_c_acctbal_-1', 'c_nationkey:1,c_acctbal:-1', 2, false), ('by name', 'c_name:1', 2, true)) t(name, keys, v, sparse)", "name string, keys string, v int, sparse boolean", _listed)

# -- stored collections


def _stored(t: Tables) -> list[tuple]:
    """Versions of a stored collection, in a folder that goes at the end."""
    root = f"{(t.spark.conf.get('spark.checkpoint.dir', None) or t.spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/folio-{uuid.uuid4().hex}"
    client = Client(t.spark, root)
    try:
        c = client["shop"].create_collection("nations", IDS["nation"])
        c.insert_df(t["nation"].df())
        c.insert_many([nation(900, "A"), nation(901, "B")])
        c.update_many({"n_nationkey": {"$gte": 900}}, {"$set": {"n_regionkey": 4}})
        c.insert_one(nation(902, "C"))
        c.create_index({"n_name": 1}, unique=True)
        client["shop"].checkpoint()
        client["shop"].backup(f"{root}/copy")
        client.close()
        again = Client(t.spark, root)["shop"]
        copy = Collection.from_parquet(t.spark, f"{root}/copy/nations", IDS["nation"])
        out = [("names", len(again.list_collections())), ("documents", again["nations"].count_documents()), ("updated", again["nations"].count_documents({"n_regionkey": 4, "n_nationkey": {"$gt": 800}})), ("copy", copy.count_documents()), ("indexes", len(again["nations"].list_indexes())), ("twice", refused(lambda: again["nations"].insert_one(nation(903, "C"))))]
        again.drop_collection("nations")
        return out + [("dropped", len(again.list_collections()))]
    finally:
        where = t.spark._jvm.org.apache.hadoop.fs.Path(root)
        where.getFileSystem(t.spark._jsc.hadoopConfiguration()).delete(where, True)


rows("stored_collections", "SELECT * FROM (VALUES ('names', 1), ('updated', 2), ('indexes', 2), ('twice', 11000), ('dropped', 0)) t(what, n) UNION ALL SELECT unnest(['documents', 'copy']), count(*) + 3 FROM nation", "what string, n long", _stored)


def _limits(t: Tables) -> list[tuple]:
    deep: dict = {}
    for _ in range(100):
        deep = {"a": deep}
    acts = {"deep": deep, "wide": {f"f{k}": 1 for k in range(10_001)}, "name": {"x" * 1025: 1}, "nul": {"a\0": 1}, "large": {"a": "x" * (16 * 1024 * 1024 + 1)}, "fine": {"a": 1}}
    return [(name, refused(lambda d=doc: documents.validate(d)) != 0) for name, doc in acts.items()]


rows("document_limits", "SELECT kind, kind <> 'fine' AS refused FROM (SELECT unnest(['deep', 'wide', 'name', 'nul', 'large', 'fine']) AS kind)", "kind string, refused boolean", _limits)
query("ttl_of_part", "SELECT event_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-03' AND event_type = 'view')", lambda t: _swept(t))


def _swept(t: Tables) -> DataFrame:
    c = t["events"]
    c.create_index({"ts": 1}, expire_after=0, partial={"event_type": "view"})
    c.sweep_expired(dt.datetime(2024, 1, 3))
    return c.df().select("event_id")
