"""Commands as documents, answered as documents; no sockets."""

from __future__ import annotations

import itertools
import time
from typing import TYPE_CHECKING

from .errors import BadValue, CursorNotFound, EngineError, UnsupportedOperator
from .plans.pipeline import whole

if TYPE_CHECKING:
    from .client import Collection, Cursor, Database

IDLE_SECONDS = 600
_ids = itertools.count(1)


def run(db: Database, command: dict) -> dict:
    """The reply to a command: ok 1, or ok 0 with code and errmsg."""
    name = next(iter(command), "")
    try:
        if "collation" in command:
            raise BadValue("collation is not supported")
        if name not in COMMANDS:
            raise EngineError(f"no such command {name!r}", 59)
        return COMMANDS[name](db, command) | {"ok": 1.0}
    except EngineError as e:
        return {"ok": 0.0, "code": e.code, "errmsg": str(e)}


def _collection(db: Database, command: dict) -> Collection:
    name = command[next(iter(command))]
    if not isinstance(name, str):
        raise BadValue("a command names a collection")
    return db.collection(name)


def _cursors(db: Database) -> dict[int, tuple[Cursor, str, float]]:
    held = getattr(db, "client", db).__dict__.setdefault("cursors", {})
    for key in [k for k, (_, _, used) in held.items() if time.monotonic() - used > IDLE_SECONDS]:
        del held[key]
    return held


def _open(db: Database, cursor: Cursor, name: str) -> dict:
    batch, space = cursor.next_batch(), f"{db.name}.{name}"
    key = 0
    if len(batch) == cursor.batch_size:
        key = next(_ids)
        _cursors(db)[key] = (cursor, space, time.monotonic())
    return {"cursor": {"id": key, "ns": space, "firstBatch": batch}}


def _find(db: Database, c: dict) -> dict:
    found = _collection(db, c).find(c.get("filter", {})).skip(c.get("skip", 0)).limit(c.get("limit", 0)).batch_size(c.get("batchSize", 0))
    for key, to in (("sort", found.sort), ("projection", found.projection), ("hint", found.hint)):
        if c.get(key):
            to(c[key])
    return _open(db, found.run(), c["find"])


def _aggregate(db: Database, c: dict) -> dict:
    if not isinstance(c.get("cursor"), dict):
        raise BadValue("aggregate needs a cursor")
    if not isinstance(c["aggregate"], str):
        raise BadValue("aggregate works on a collection")
    if db.get(c["aggregate"]) is None:
        return {"cursor": {"id": 0, "ns": f"{db.name}.{c['aggregate']}", "firstBatch": []}}
    return _open(db, _collection(db, c).aggregate(c["pipeline"], c["cursor"].get("batchSize", 0)), c["aggregate"])


def _get_more(db: Database, c: dict) -> dict:
    held = _cursors(db)
    if c["getMore"] not in held:
        raise CursorNotFound(f"no cursor {c['getMore']}")
    cursor, space, _ = held.pop(c["getMore"])
    if c.get("batchSize", 0) > 0:
        cursor.batch_size = c["batchSize"]
    batch, key = cursor.next_batch(), 0
    if len(batch) == cursor.batch_size:
        key = c["getMore"]
        held[key] = (cursor, space, time.monotonic())
    return {"cursor": {"id": key, "ns": space, "nextBatch": batch}}


def _kill_cursors(db: Database, c: dict) -> dict:
    held = _cursors(db)
    there = [k for k in c["cursors"] if held.pop(k, None)]
    return {"cursorsKilled": there, "cursorsNotFound": [k for k in c["cursors"] if k not in there], "cursorsAlive": [], "cursorsUnknown": []}


def _insert(db: Database, c: dict) -> dict:
    docs = c.get("documents") or []
    if not docs:
        raise BadValue("insert needs documents")
    if len(docs) == 1:
        try:
            return {"n": len(_collection(db, c).insert_one(docs[0]).inserted_ids)}
        except EngineError as e:
            return {"n": 0, "writeErrors": [{"index": 0, "code": e.code, "errmsg": str(e)}]}
    done = _collection(db, c).insert_many(docs, c.get("ordered", True))
    return {"n": len(done.inserted_ids)} | ({"writeErrors": done.errors} if done.errors else {})


def _update(db: Database, c: dict) -> dict:
    n = modified = 0
    upserted, errors = [], []
    for at, one in enumerate(c.get("updates") or []):
        try:
            coll, u = _collection(db, c), one["u"]
            if isinstance(u, dict) and not any(k.startswith("$") for k in u):
                if one.get("multi"):
                    raise BadValue("a replacement is of one document")
                done = coll.replace_one(one["q"], u, one.get("upsert", False))
            else:
                done = (coll.update_many if one.get("multi") else coll.update_one)(one["q"], u, one.get("upsert", False), one.get("arrayFilters"))
            n += done.matched_count + (done.upserted_id is not None)
            modified += done.modified_count
            if done.upserted_id is not None:
                upserted.append({"index": at, "_id": done.upserted_id})
        except EngineError as e:
            errors.append({"index": at, "code": e.code, "errmsg": str(e)})
            if c.get("ordered", True):
                break
    return {"n": n, "nModified": modified} | ({"upserted": upserted} if upserted else {}) | ({"writeErrors": errors} if errors else {})


def _delete(db: Database, c: dict) -> dict:
    n = 0
    for one in c.get("deletes") or []:
        if one.get("limit") not in (0, 1):
            raise BadValue("a delete's limit is 0 or 1")
        coll = _collection(db, c)
        n += (coll.delete_one if one["limit"] else coll.delete_many)(one["q"]).deleted_count
    return {"n": n}


def _find_and_modify(db: Database, c: dict) -> dict:
    coll, query, sort = _collection(db, c), c.get("query", {}), c.get("sort") or None
    update, remove, new, upsert = c.get("update"), c.get("remove", False), c.get("new", False), c.get("upsert", False)
    if bool(update is not None) == bool(remove) or remove and (new or upsert):
        raise BadValue("findAndModify updates or removes")
    before = coll._first(query, sort)
    if remove:
        return {"value": coll.find_one_and_delete(query, sort), "lastErrorObject": {"n": int(before is not None)}}
    if isinstance(update, dict) and not any(k.startswith("$") for k in update):
        value = coll.find_one_and_replace(query, update, sort, new, upsert)
    else:
        value = coll.find_one_and_update(query, update, sort, new, upsert, c.get("arrayFilters"))
    return {"value": value, "lastErrorObject": {"n": int(before is not None or upsert), "updatedExisting": before is not None}}


def _count(db: Database, c: dict) -> dict:
    return {"n": _collection(db, c).count(c.get("query", {}), whole(c.get("skip", 0), 0, "skip"), int(c.get("limit", 0)))}


def _explain(db: Database, c: dict) -> dict:
    inner = c["explain"]
    if not isinstance(inner, dict) or next(iter(inner), "") != "find":
        raise UnsupportedOperator("explain is of find")
    asked = _collection(db, inner).find(inner.get("filter", {}))
    for key, to in (("sort", asked.sort), ("hint", asked.hint), ("projection", asked.projection)):
        if inner.get(key):
            to(inner[key])
    found = asked.skip(inner.get("skip", 0)).limit(inner.get("limit", 0)).explain()
    return {"queryPlanner": {"winningPlan": {"stage": found["plan"]}, "pushedFilters": found["pushed_filters"]}, "sparkPlan": found["spark_plan"]}


def _create_indexes(db: Database, c: dict) -> dict:
    coll = _collection(db, c)
    before = len(coll.list_indexes())
    for one in c.get("indexes") or []:
        options = {to: one[key] for key, to in (("name", "name"), ("unique", "unique"), ("sparse", "sparse"), ("partialFilterExpression", "partial"), ("expireAfterSeconds", "expire_after")) if key in one}
        coll.create_index(one["key"], **options)
    return {"numIndexesBefore": before, "numIndexesAfter": len(coll.list_indexes())}


def _drop_indexes(db: Database, c: dict) -> dict:
    coll = _collection(db, c)
    before = len(coll.list_indexes())
    coll.drop_index(c["index"])
    return {"nIndexesWas": before}


def _drop(db: Database, c: dict) -> dict:
    if db.get(c["drop"]) is None:
        raise EngineError(f"no collection {c['drop']}", 26)
    db.drop_collection(c["drop"])
    return {"ns": f"{db.name}.{c['drop']}"}


def _batch(db: Database, name: str, docs: list[dict]) -> dict:
    return {"cursor": {"id": 0, "ns": f"{db.name}.{name}", "firstBatch": docs}}


_HELLO = {"isWritablePrimary": True, "ismaster": True, "maxBsonObjectSize": 16 * 1024 * 1024, "maxWriteBatchSize": 100_000, "minWireVersion": 0, "maxWireVersion": 25, "readOnly": False}
COMMANDS = {
    "hello": lambda db, c: dict(_HELLO), "isMaster": lambda db, c: dict(_HELLO), "ismaster": lambda db, c: dict(_HELLO), "ping": lambda db, c: {}, "endSessions": lambda db, c: {},
    "buildInfo": lambda db, c: {"version": "8.0.0", "versionArray": [8, 0, 0, 0]}, "serverStatus": lambda db, c: {"process": "folio", "spark": db.spark.version},
    "listDatabases": lambda db, c: {"databases": [{"name": n} for n in (db.client.list_databases() if hasattr(db, "client") else [db.name])]},
    "dropDatabase": lambda db, c: (db.drop(), {"dropped": db.name})[1], "create": lambda db, c: (db.create_collection(c["create"]), {})[1], "drop": _drop,
    "listCollections": lambda db, c: _batch(db, "$cmd.listCollections", [{"name": n, "type": "collection"} for n in db.list_collections()]),
    "insert": _insert, "find": _find, "update": _update, "delete": _delete, "findAndModify": _find_and_modify, "aggregate": _aggregate, "count": _count,
    "distinct": lambda db, c: {"values": _collection(db, c).distinct(c["key"], c.get("query", {}))}, "explain": _explain, "getMore": _get_more, "killCursors": _kill_cursors,
    "createIndexes": _create_indexes, "dropIndexes": _drop_indexes, "listIndexes": lambda db, c: _batch(db, c["listIndexes"], _collection(db, c).list_indexes()),
}
