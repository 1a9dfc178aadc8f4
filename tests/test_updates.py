import datetime as dt

import pytest

from folio import Client
from folio.errors import BadValue, CannotCreateIndex, DocumentTooLarge, DocumentValidationFailure, DuplicateKey, EngineError
from folio.sources import documents

DOC = {"n": 5, "f": 1.5, "s": "x", "t": [3, 1, 2], "o": {"a": 1, "b": 2}, "items": [{"k": "x", "v": 1}, {"k": "y", "v": 2}], "when": dt.datetime(2020, 1, 1), "z": 0}
CASES = [
    ({"$set": {"n": 9, "o.c.d": 1}}, {"n": 9, "o": {"a": 1, "b": 2, "c": {"d": 1}}}),
    ({"$unset": {"s": "", "o.a": ""}}, {"s": None, "o": {"b": 2}}),
    ({"$inc": {"n": 2, "f": 1, "new": 3}}, {"n": 7, "f": 2.5, "new": 3.0}),
    ({"$inc": {"n": 1.9}}, {"n": 6}),
    ({"$mul": {"n": 3, "new": 5}}, {"n": 15, "new": 0.0}),
    ({"$min": {"n": 3, "f": 9, "new": 1}}, {"n": 3, "f": 1.5, "new": 1}),
    ({"$max": {"n": 3, "f": 9}}, {"n": 5, "f": 9.0}),
    ({"$rename": {"s": "o.s", "gone": "x"}}, {"s": None, "o": {"a": 1, "b": 2, "s": "x"}}),
    ({"$bit": {"n": {"and": 4}}}, {"n": 4}),
    ({"$bit": {"n": {"xor": 1}, "nb": {"or": 6}}}, {"n": 4, "nb": 6}),
    ({"$push": {"t": 9}}, {"t": [3, 1, 2, 9]}),
    ({"$push": {"t": {"$each": [8, 9], "$position": 1}}}, {"t": [3, 8, 9, 1, 2]}),
    ({"$push": {"t": {"$each": [8], "$position": -1}}}, {"t": [3, 1, 8, 2]}),
    ({"$push": {"t": {"$each": [], "$sort": -1, "$slice": 2}}}, {"t": [3, 2]}),
    ({"$push": {"t": {"$each": [7], "$slice": -2}}}, {"t": [2, 7]}),
    ({"$push": {"items": {"$each": [{"k": "z", "v": 0}], "$sort": {"v": 1}}}}, {"items": [{"k": "z", "v": 0}, {"k": "x", "v": 1}, {"k": "y", "v": 2}]}),
    ({"$push": {"list": 1}}, {"list": [1]}),
    ({"$addToSet": {"t": 1}}, {"t": [3, 1, 2]}),
    ({"$addToSet": {"t": {"$each": [1, 4, 4]}}}, {"t": [3, 1, 2, 4]}),
    ({"$pull": {"t": 1}}, {"t": [3, 2]}),
    ({"$pull": {"t": {"$gte": 2}}}, {"t": [3, 1, 2]}),
    ({"$pull": {"items": {"v": {"$gte": 2}}}}, {"items": [{"k": "x", "v": 1}]}),
    ({"$pullAll": {"t": [1, 3]}}, {"t": [2]}),
    ({"$pop": {"t": 1}}, {"t": [3, 1]}),
    ({"$pop": {"t": -1}}, {"t": [1, 2]}),
    ({"$set": {"t.$[]": 0}}, {"t": [0, 0, 0]}),
    ({"$inc": {"items.$[].v": 10}}, {"items": [{"k": "x", "v": 11}, {"k": "y", "v": 12}]}),
    ({"$set": {"items.$[].tag": "q"}}, {"items": [{"k": "x", "v": 1, "tag": "q"}, {"k": "y", "v": 2, "tag": "q"}]}),
    ([{"$set": {"n": {"$add": ["$n", "$f"]}, "_id": 99}}, {"$unset": "s"}], {"n": 6.5, "s": None}),
]


def bare(v):
    """Without nulls: a frame of one schema gives every row every field."""
    if isinstance(v, dict):
        return {k: bare(x) for k, x in v.items() if x is not None}
    return [bare(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("update,want", CASES, ids=[str(c[0])[:60] for c in CASES])
def test_update_many(collection, update, want):
    c = collection([DOC, DOC | {"z": 1}])
    done = c.update_many({"z": 0}, update)
    assert done.matched_count == 1
    got = {d["_id"]: d for d in c.find().run()}
    assert {k: bare(got[0].get(k)) for k in want} == want and got[0]["_id"] == 0
    unchanged = {k: v for k, v in got[0].items() if k in DOC and k not in want}
    assert unchanged == {k: DOC[k] for k in unchanged}
    assert done.modified_count == int(bare(got[0]) != DOC | {"_id": 0})
    assert bare(got[1]) == DOC | {"z": 1, "_id": 1}


def test_array_filters_and_positional(collection):
    c = collection([DOC])
    c.update_one({}, {"$inc": {"items.$[e].v": 5}, "$set": {"t.$[x]": 0}}, array_filters=[{"e.k": "y"}, {"x": {"$gte": 2}}])
    assert c.find_one()["items"][1]["v"] == 7 and c.find_one()["t"] == [0, 1, 0]
    c.update_one({"t": 1}, {"$set": {"t.$": 50}})
    assert c.find_one()["t"] == [0, 50, 0]
    for update, filters in (({"$set": {"t.$[a]": 1}}, None), ({"$set": {"n": 1}}, [{"a": 1}]), ({"$set": {"t.$[a]": 1}}, [{"a": 1}, {"a": 2}]), ({"$set": {"t.$": 1}}, None), ({"$set": {"n.$[]": 1}}, None)):
        with pytest.raises(BadValue):
            c.update_one({"n": 5}, update, array_filters=filters)


@pytest.mark.parametrize("update", [{"n": 1}, {}, {"$nope": {"n": 1}}, {"$push": {"n": 1}}, {"$inc": {"s": 1}}, {"$inc": {"n": "x"}}, {"$bit": {"f": {"or": 1}}}, {"$pop": {"n": 1}}, [{"$match": {}}], {"$set": {"a..b": 1}}])
def test_bad_updates(collection, update):
    with pytest.raises(EngineError):
        collection([DOC]).update_many({}, update)


def test_stored_collections(spark, tmp_path):
    root = str(tmp_path)
    c = Client(spark, root)["db"]["c"]
    done = c.insert_many([{"_id": 1, "v": "a"}, {"_id": 1, "v": "b"}, {"_id": 2, "v": "c"}], ordered=False)
    assert done.inserted_ids == [1, 2] and done.errors[0]["code"] == 11000
    assert c.insert_many([{"_id": 3, "v": "d"}, {"_id": 3}, {"_id": 4}]).inserted_ids == [3]
    with pytest.raises(DuplicateKey):
        c.insert_one({"_id": 3})
    assert c.update_one({"_id": 9, "k.x": 1, "v": {"$gt": "a"}}, {"$set": {"v": "u"}, "$setOnInsert": {"w": 2}}, upsert=True).upserted_id == 9
    assert c.find_one({"_id": 9}) == {"_id": 9, "v": "u", "k": {"x": 1}, "w": 2}
    assert c.replace_one({"_id": 1}, {"v": "r"}).modified_count == 1 and c.replace_one({"_id": 1}, {"v": "r"}).modified_count == 0
    assert c.find_one_and_update({}, {"$set": {"v": "top"}}, sort={"_id": -1}, after=True)["v"] == "top"
    assert c.find_one_and_replace({"_id": 2}, {"v": "p"})["v"] == "c" and c.find_one_and_delete({"_id": 2})["v"] == "p"
    with pytest.raises(BadValue):
        c.replace_one({"_id": 1}, {"_id": 5})
    assert c.create_index({"v": 1, "w": -1}, unique=True) == "v_1_w_-1"
    with pytest.raises(DuplicateKey):
        c.insert_one({"_id": 50, "v": "top", "w": 2})
    again = Client(spark, root)["db"]["c"]
    assert again.count_documents() == 3 and len(again.list_indexes()) == 2 and sorted(again.distinct("v")) == ["d", "r", "top"]
    assert again.find().hint("v_1_w_-1").sort({"_id": 1}).skip(1).limit(1).run().to_list()[0]["_id"] == 3
    with pytest.raises(BadValue):
        again.find().hint("nope").to_df()
    assert again.delete_one({}).deleted_count == 1 and again.delete_many({}).deleted_count == 2 and again.count_documents() == 0
    store = again._store
    version = store.version()
    store.vacuum()
    assert store.version() == version and again.count_documents() == 0


def test_indexes(collection):
    c = collection([{"e": "a", "ok": True, "t": [1, 2]}, {"e": "a", "ok": False, "t": [2]}, {"e": None, "ok": False, "t": []}])
    with pytest.raises(DuplicateKey):
        c.create_index({"e": 1}, unique=True)
    assert c.create_index({"e": 1}, unique=True, partial={"ok": True}) == "e_1"
    with pytest.raises(DuplicateKey):
        c.create_index({"t": 1}, unique=True)
    for keys, options in (({"e": "text"}, {}), ({"e": 1}, {"partial": {}}), ({"_id": 1}, {"partial": {"e": 1}}), ({"e": 1, "t": 1}, {"expire_after": 1}), ({"e": 1}, {"partial": {"e": 1}, "sparse": True}), ({}, {})):
        with pytest.raises(CannotCreateIndex):
            c.create_index(keys, **options)
    c.drop_index("e_1")
    assert [i["name"] for i in c.list_indexes()] == ["_id_"]


def test_expiry(collection):
    old, new = dt.datetime(2020, 1, 1), dt.datetime(2030, 1, 1)
    c = collection([{"at": old, "ats": [new, new], "s": "x"}, {"at": new, "ats": [new, old], "s": "x"}, {"at": None, "ats": None, "s": "x"}])
    c.create_index({"s": 1}, expire_after=0)
    assert c.sweep_expired(dt.datetime(2025, 1, 1)) == 0
    c.create_index({"ats": 1}, expire_after=60)
    assert c.sweep_expired(dt.datetime(2025, 1, 1)) == 1
    c.create_index({"at": 1}, expire_after=60, partial={"s": "x"})
    assert c.sweep_expired(dt.datetime(2025, 1, 1)) == 1 and [d["_id"] for d in c.find().run()] == [2]


def test_limits():
    deep = cur = {}
    for _ in range(100):
        cur["x"] = cur = {}
    for doc, error in ((deep, DocumentValidationFailure), ({str(k): 1 for k in range(10_001)}, DocumentValidationFailure), ({"a" * 1025: 1}, DocumentValidationFailure), ({"a\0": 1}, DocumentValidationFailure), ({"s": "x" * (16 * 1024 * 1024 + 1)}, DocumentTooLarge)):
        with pytest.raises(error):
            documents.validate(doc)
    documents.validate(deep["x"])
    documents.validate({str(k): 1 for k in range(10_000)})
    assert len({documents.new_id() for _ in range(100)}) == 100


def test_commands(spark, tmp_path):
    db = Client(spark, str(tmp_path))["d"]
    run = db.run_command
    assert run({"ping": 1})["ok"] == 1 and run({"nope": 1})["code"] == 59 and run({"find": "t", "collation": {}})["code"] == 2
    assert run({"insert": "t", "documents": [{"_id": k, "v": k % 3} for k in range(7)]})["n"] == 7
    first = run({"find": "t", "filter": {"v": {"$lt": 2}}, "sort": {"_id": 1}, "batchSize": 3})["cursor"]
    more = run({"getMore": first["id"], "collection": "t"})["cursor"]
    assert [d["_id"] for d in first["firstBatch"] + more["nextBatch"]] == [0, 1, 3, 4, 6] and more["id"] == 0
    assert run({"getMore": 12345})["code"] == 43 and run({"killCursors": "t", "cursors": [7]})["cursorsNotFound"] == [7]
    assert run({"count": "t", "query": {"v": 0}, "skip": 1, "limit": -5})["n"] == 2 and run({"count": "t", "skip": -1})["code"] == 2
    assert sorted(run({"distinct": "t", "key": "v"})["values"]) == [0, 1, 2]
    assert run({"aggregate": "t", "pipeline": []})["code"] == 2 and run({"aggregate": "none", "pipeline": [{"$count": "n"}], "cursor": {}})["cursor"]["firstBatch"] == []
    assert run({"aggregate": "t", "pipeline": [{"$sortByCount": "$v"}], "cursor": {}})["cursor"]["firstBatch"][0] == {"_id": 0, "count": 3}
    assert run({"update": "t", "updates": [{"q": {"v": 1}, "u": {"$set": {"v": 10}}, "multi": True}, {"q": {"_id": 99}, "u": {"v": 5}, "upsert": True}]}) == {"n": 3, "nModified": 2, "upserted": [{"index": 1, "_id": 99}], "ok": 1.0}
    assert run({"findAndModify": "t", "query": {"_id": 99}, "update": {"$inc": {"v": 1}}, "new": True})["value"]["v"] == 6
    assert run({"findAndModify": "t", "query": {"_id": 99}, "remove": True})["value"]["v"] == 6
    assert run({"delete": "t", "deletes": [{"q": {"v": 10}, "limit": 0}]})["n"] == 2
    assert run({"createIndexes": "t", "indexes": [{"key": {"v": 1}, "name": "byv"}]})["numIndexesAfter"] == 2
    assert len(run({"listIndexes": "t"})["cursor"]["firstBatch"]) == 2 and run({"dropIndexes": "t", "index": "byv"})["nIndexesWas"] == 2
    assert "FileScan" in run({"explain": {"find": "t", "filter": {"v": 0}}})["sparkPlan"].replace("Scan parquet", "FileScan")
    assert [c["name"] for c in run({"listCollections": 1})["cursor"]["firstBatch"]] == ["t"] and run({"create": "t"})["code"] == 48
    assert run({"listDatabases": 1})["databases"] == [{"name": "d"}] and run({"drop": "t"})["ok"] == 1 and run({"drop": "t"})["code"] == 26


def test_inserts_write_only_what_is_new(spark, tmp_path):
    c = Client(spark, str(tmp_path))["d"]["t"]
    for k in range(3):
        c.insert_many([{"_id": 10 * k + j, "v": j} for j in range(4)])
    store = c._store
    assert store.meta()["data"] == [1, 2, 3] and c.count_documents() == 12
    assert spark.read.parquet(f"{tmp_path}/d/t/data/3").count() == 4
    c.insert_one({"_id": 99, "other": "x"})  # a new field: all parts become one
    assert len(store.meta()["data"]) == 1 and c.find_one({"_id": 99})["other"] == "x"
    c.insert_one({"_id": 100, "v": 1})
    store.vacuum()
    assert c.count_documents() == 14 and c.delete_many({"v": 3}).deleted_count == 3 and c.count_documents() == 11
