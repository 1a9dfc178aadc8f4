import datetime as dt
import math
import os

import duckdb
import pytest

from folio import Collection, Database, queries
from folio.errors import BadValue, EngineError, UnsupportedOperator

D = dt.datetime(2021, 3, 15, 13, 45, 30, 250000)
DOC = {"i": 7, "n": -3, "f": 2.5, "s": "Hello", "e": "", "t": [3, 1, 2], "o": {"a": 1, "b": "x"}, "d": D, "b": True, "z": None, "w": "  x\t", "docs": [{"k": 1}, {"k": 2}]}
VALUES = [
    ({"$add": ["$i", 1, "$f"]}, 10.5), ({"$add": ["$i", None]}, None), ({"$add": ["$d", 1000]}, D + dt.timedelta(seconds=1)), ({"$subtract": ["$d", dt.datetime(2021, 3, 15)]}, 49530250), ({"$subtract": ["$i", "$n"]}, 10),
    ({"$multiply": ["$i", "$n"]}, -21), ({"$divide": ["$i", 2]}, 3.5), ({"$mod": ["$n", 2]}, -1), ({"$mod": ["$f", 2]}, 0.5), ({"$pow": ["$i", 2]}, 49), ({"$pow": [2, -1]}, 0.5), ({"$abs": "$n"}, 3), ({"$ceil": "$f"}, 3.0),
    ({"$floor": -2.5}, -3.0), ({"$trunc": -2.5}, -2.0), ({"$round": "$f"}, 2.0), ({"$round": [3.5]}, 4.0), ({"$round": [1234.5, -2]}, 1200.0), ({"$round": [1250, -2]}, 1200), ({"$sqrt": 16}, 4.0), ({"$ln": 1}, 0.0), ({"$log10": 100}, 2.0), ({"$exp": 0}, 1.0),
    ({"$eq": ["$i", 7.0]}, True), ({"$eq": ["$zz", None]}, True), ({"$ne": ["$s", 1]}, True), ({"$gt": ["$s", 1]}, True), ({"$lt": ["$z", -5]}, True), ({"$gte": ["$t", [3]]}, True), ({"$eq": ["$z", "q"]}, False), ({"$gt": ["$z", "q"]}, False), ({"$cmp": ["$i", "$f"]}, 1), ({"$cmp": ["$zz", "$z"]}, 0),
    ({"$and": ["$i", "$e"]}, True), ({"$and": []}, True), ({"$or": ["$z", 0]}, False), ({"$not": ["$z"]}, True), ({"$cond": ["$b", "y", "n"]}, "y"), ({"$cond": {"if": "$z", "then": 1, "else": 2.5}}, 2.5),
    ({"$ifNull": ["$z", "$zz", "d"]}, "d"), ({"$switch": {"branches": [{"case": {"$gt": ["$i", 9]}, "then": 1}, {"case": True, "then": 2}]}}, 2), ({"$concat": ["$s", "!", "$e"]}, "Hello!"), ({"$concat": ["$s", "$z"]}, None),
    ({"$toUpper": "$s"}, "HELLO"), ({"$toLower": "$z"}, None), ({"$strLenCP": "é\U0001f600"}, 2), ({"$substrCP": ["$s", 1, 3]}, "ell"), ({"$substrCP": ["$z", 0, 3]}, ""), ({"$substrCP": ["$s", 9, 3]}, ""), ({"$split": ["a.b..c", "."]}, ["a", "b", "", "c"]),
    ({"$trim": {"input": "$w"}}, "x"), ({"$ltrim": {"input": "xxyx", "chars": "x"}}, "yx"), ({"$rtrim": {"input": "xxyx", "chars": "xy"}}, ""), ({"$toString": 1.0}, "1"), ({"$toString": 1.5}, "1.5"), ({"$toString": "$d"}, "2021-03-15T13:45:30.250Z"), ({"$toString": True}, "true"),
    ({"$size": "$t"}, 3), ({"$isArray": "$t"}, True), ({"$isArray": "$zz"}, False), ({"$in": [2, "$t"]}, True), ({"$in": [None, [1, None]]}, True), ({"$arrayElemAt": ["$t", -1]}, 2), ({"$arrayElemAt": ["$t", 9]}, None), ({"$first": "$t"}, 3), ({"$last": "$t"}, 2),
    ({"$concatArrays": ["$t", [9]]}, [3, 1, 2, 9]), ({"$slice": ["$t", -2]}, [1, 2]), ({"$slice": ["$t", -5, 2]}, [3, 1]), ({"$slice": ["$t", 1, 5]}, [1, 2]), ({"$slice": ["$t", 0]}, []), ({"$filter": {"input": "$t", "as": "x", "cond": {"$gt": ["$$x", 1]}}}, [3, 2]),
    ({"$map": {"input": "$t", "in": {"$add": ["$$this", "$i"]}}}, [10, 8, 9]), ({"$range": [0, 5, 2]}, [0, 2, 4]), ({"$range": [3, 0, -1]}, [3, 2, 1]), ({"$range": [3, 0]}, []), ({"$type": "$i"}, "long"), ({"$type": "$zz"}, "missing"), ({"$type": "$z"}, "null"),
    ({"$toInt": "3.0"}, 3), ({"$toLong": 3.9}, 3), ({"$toDouble": " 2.5 "}, 2.5), ({"$toInt": True}, 1), ({"$toBool": 0}, False), ({"$toBool": "x"}, True), ({"$toDate": 0}, dt.datetime(1970, 1, 1)), ({"$year": "$d"}, 2021), ({"$month": "$d"}, 3), ({"$dayOfMonth": "$d"}, 15),
    ({"$hour": "$d"}, 13), ({"$minute": "$d"}, 45), ({"$second": "$d"}, 30), ({"$millisecond": "$d"}, 250), ({"$dayOfWeek": "$d"}, 2), ({"$dayOfYear": "$d"}, 74), ({"$literal": "$i"}, "$i"), ("$o.a", 1), ("$t.1", 1), ("$docs.k", None), ("$$ROOT.o.b", "x"), ([1, "$zz"], [1, None]),
    ({"q": "$i", "gone": "$zz"}, {"q": 7}),
]


def test_expressions(collection):
    c = collection([DOC])
    made = c.aggregate([{"$project": {f"v{k}": e for k, (e, _) in enumerate(VALUES)}}]).to_list()[0]
    for k, (e, want) in enumerate(VALUES):
        got = made.get(f"v{k}")
        assert got == pytest.approx(want) if isinstance(want, float) else got == want, (e, got)
        assert not (isinstance(want, float) and isinstance(got, int)), e


@pytest.mark.parametrize("e", [{"$divide": ["$i", 0]}, {"$sqrt": "$n"}, {"$ln": 0}, {"$mod": ["$i", 0]}, {"$switch": {"branches": [{"case": "$z", "then": 1}]}}, {"$toInt": 3e10}, {"$arrayElemAt": [{"$slice": ["$t", 0, "$n"]}, 0]}])
def test_errors_of_values(collection, e):
    with pytest.raises(Exception):  # noqa: B017  raised by the running query
        collection([DOC]).aggregate([{"$project": {"v": e}}]).to_list()


@pytest.mark.parametrize("e", [{"$add": ["$s", 1]}, {"$concat": ["$i"]}, {"$size": "$z"}, {"$year": "$i"}, {"$toString": "$t"}, {"$cond": [1, 2]}, {"$toDate": "x"}, {"$split": ["a", ""]}, {"$range": [0, 5, 0]}, "$$nope", {"$eq": [1]}, {"$add": ["$d", "$d"]}])
def test_errors_of_types(collection, e):
    with pytest.raises(BadValue):
        collection([DOC]).aggregate([{"$project": {"v": e}}])


@pytest.mark.parametrize("stage", [{"$facet": {}}, {"$unionWith": "x"}, {"$project": {"v": {"$reduce": {}}}}, {"$group": {"_id": None, "x": {"$median": 1}}}, {"$lookup": {"from": "x", "let": {}, "pipeline": [], "as": "y"}}])
def test_unsupported(collection, stage):
    with pytest.raises(UnsupportedOperator):
        collection([DOC]).aggregate([stage])


@pytest.mark.parametrize("stage", [{"$limit": 0}, {"$skip": -1}, {"$sort": {}}, {"$sort": {"a": 2}}, {"$count": "a.b"}, {"$count": "$x"}, {"$group": {"x": {"$sum": 1}}}, {"$group": {"_id": 1, "x": 5}}, {"$unwind": "t"}, {"$match": 1}, {"$unset": []}, {"$limit": 1, "$skip": 1}])
def test_bad_stages(collection, stage):
    with pytest.raises(EngineError):
        collection([DOC]).aggregate([stage])


def test_group_accumulators(collection):
    c = collection([{"g": "a", "v": v, "x": x} for v, x in ((2, 1.0), (4, float("nan")), (None, 3.0), (4, -1.0))] + [{"g": None, "v": 5, "x": None}])
    spec = {"s": {"$sum": "$v"}, "bad": {"$sum": "$g"}, "avg": {"$avg": "$v"}, "noavg": {"$avg": "$g"}, "lo": {"$min": "$x"}, "hi": {"$max": "$x"}, "f": {"$first": "$v"}, "l": {"$last": "$v"}, "p": {"$push": "$v"}, "set": {"$addToSet": "$v"}, "n": {"$count": {}}, "sd": {"$stdDevPop": "$v"}, "ss": {"$stdDevSamp": "$v"}, "fn": {"$firstN": {"input": "$v", "n": 3}}, "ln": {"$lastN": {"input": "$v", "n": 2}}, "mn": {"$minN": {"input": "$v", "n": 2}}, "mx": {"$maxN": {"input": "$v", "n": 2}}, "gone": {"$push": "$zz"}}
    got = {d["_id"]: d for d in c.aggregate([{"$sort": {"_id": -1}}, {"$group": {"_id": "$g"} | spec}]).to_list()}
    a = got["a"]
    assert (a["s"], a["bad"], a["noavg"], a["hi"], a["f"], a["l"], a["p"], a["set"], a["n"]) == (10, 0, None, 3.0, 4, 2, [4, None, 4, 2], [None, 2, 4], 4)
    assert math.isnan(a["lo"]) and a["avg"] == pytest.approx(10 / 3) and a["sd"] == pytest.approx((8 / 9) ** 0.5) and a["fn"] == [4, None, 4] and a["ln"] == [4, 2] and a["mn"] == [2, 4] and a["mx"] == [4, 4] and a["gone"] == []
    assert got[None]["ss"] is None and got[None]["sd"] == 0.0 and got[None]["lo"] is None


def test_group_of_nothing(collection):
    c = collection([DOC])
    assert c.aggregate([{"$match": {"i": 0}}, {"$group": {"_id": None, "n": {"$sum": 1}}}]).to_list() == []
    assert c.aggregate([{"$match": {"i": 0}}, {"$count": "n"}]).to_list() == [{"n": 0}]


def test_unwind_edges(collection):
    c = collection([{"t": [1, 2]}, {"t": []}, {"t": None}])
    rows = lambda spec: [(d["_id"], d["t"], d.get("at")) for d in c.aggregate([{"$unwind": spec}, {"$sort": {"_id": 1, "at": 1}}]).to_list()]
    assert [r[:2] for r in rows("$t")] == [(0, 1), (0, 2)]
    assert rows({"path": "$t", "includeArrayIndex": "at", "preserveNullAndEmptyArrays": True}) == [(0, 1, 0), (0, 2, 1), (1, None, None), (2, None, None)]


def test_projection_trees(collection):
    c = collection([{"a": [{"b": 1, "c": [{"d": 1, "e": 2}]}, {"b": 2, "c": []}], "n": {"x": 1, "y": {"z": 2, "w": 3}}, "t": [1]}])
    one = lambda spec: c.find().projection(spec).run().to_list()[0]
    assert one({"a.c.d": 1, "t.x": 1, "_id": 0}) == {"a": [{"c": [{"d": 1}]}, {"c": []}], "t": []}
    assert one({"a": 0, "n.y.z": 0, "t.x": 0}) == {"_id": 0, "n": {"x": 1, "y": {"w": 3}}, "t": [1]}
    assert one({"_id": 1}) == {"_id": 0} and "_id" not in one({"_id": 0})
    got = c.aggregate([{"$project": {"n.x": 1, "n2.deep": {"$add": ["$n.x", 1]}}}, {"$addFields": {"n.q": "$n2.deep", "n2.deep.er": 5}}, {"$unset": "n2.gone"}]).to_list()
    assert got == [{"_id": 0, "n": {"x": 1, "q": 2}, "n2": {"deep": {"er": 5}}}]


def test_lookup_null_and_array_keys(spark, collection):
    left = collection([{"k": 1, "ks": [1, 2, 2]}, {"k": None, "ks": []}, {"k": 9, "ks": None}])
    right = collection([{"k": 1, "t": "a"}, {"k": None, "t": "b"}, {"k": 2, "t": "c"}])
    db = Database(spark, "d")
    db.register("r", right.df())
    c = Collection(left.df(), database=db)
    look = lambda f: [[x["t"] for x in d["j"]] for d in c.aggregate([{"$lookup": {"from": "r", "localField": f, "foreignField": "k", "as": "j"}}, {"$sort": {"_id": 1}}]).to_list()]
    assert look("k") == [["a"], ["b"], []] and look("zz") == [["b"]] * 3 and look("ks") == [["a", "c"], [], ["b"]]
    anti = [{"$lookup": {"from": "r", "localField": "k", "foreignField": "k", "as": "j"}}, {"$match": {"j": {"$size": 0}}}, {"$project": {"k": 1}}]
    assert c.aggregate(anti).to_list() == [{"_id": 2, "k": 9}]
    assert "LeftAnti" in c.aggregate(anti).df._jdf.queryExecution().toString()


def test_plain_lookups_are_joins(spark):
    t = queries.Tables(spark, "/root/testdata/sf0.001")
    plan = t["orders"].aggregate([{"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$group": {"_id": "$c.c_mktsegment", "n": {"$sum": 1}}}]).df._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_mixed_types(spark):
    from folio.docmode import Documents, sort_key

    docs = ['{"k":1,"g":1}', '{"k":"1","g":1.0}', '{"k":null,"g":"x"}', '{"g":[1]}', '{"k":[2,"a"]}', '{"k":{"a":1}}', '{"k":true}', '{"k":-5.5}']
    d = Documents.of_json(spark.createDataFrame([(x,) for x in docs], "j string"), "j")
    assert len(d.match({"k": None}).to_list()) == 2 and len(d.match({"k": {"$exists": True}}).to_list()) == 7
    assert [x["k"] for x in d.match({"k": {"$lt": "a"}}).to_list()] == [1, "1", None, [2, "a"], -5.5]
    assert [x.get("k") for x in d.sort({"k": 1}).to_list()][2:] == [-5.5, 1, "1", {"a": 1}, [2, "a"], True]
    assert sorted((r["_id"], r["count"]) for r in d.group("g").collect()) == [('"x"', 1), ("1", 2), ("[1]", 1), ("null", 4)]
    assert {r["value"] for r in d.distinct("k").collect()} == {"1", '"1"', "null", '[2,"a"]', '{"a":1}', "true", "-5.5"}
    assert [x["k"] for x in d.match({"k": {"$regex": "^1$"}}).to_list()] == ["1"]
    assert [x["k"] for x in d.match({"k": {"$mod": [2, 0]}}).to_list()] == [[2, "a"]]
    ladder = [None, float("nan"), float("-inf"), -1, 0, 1.5, 2**53, 2**53 + 1, float("inf"), "", "a", "a\0", "b", {}, {"a": 1}, [], [1], False, True]
    assert [sort_key(x) for x in ladder] == sorted(sort_key(x) for x in ladder) and len({sort_key(x) for x in ladder}) == len(ladder)


def test_streams(spark, tmp_path):
    from folio.sources import indexes
    from folio.streaming.streams import expire_batches, stream_pipeline

    src = str(tmp_path / "src")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300).write.parquet(src)
    stream = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    counted = stream_pipeline(stream(), [{"$match": {"value": {"$gt": 0}}}, {"$group": {"_id": "$event_type", "n": {"$sum": 1}}}])
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    want = {r["event_type"]: r["count"] for r in spark.read.parquet(src).where("value > 0").groupBy("event_type").count().collect()}
    assert {r["_id"]: r["n"] for r in spark.sql("SELECT * FROM counted").collect()} == want
    with pytest.raises(UnsupportedOperator):
        stream_pipeline(stream(), [{"$sort": {"ts": 1}}])
    kept, limit = [], spark.read.parquet(src).agg({"ts": "max"}).first()[0]
    q = expire_batches(stream(), [indexes.make({"ts": 1}, "event_id", expire_after=0)], lambda df, n: kept.append(df.count()), "event_id", lambda: limit).start()
    q.processAllAvailable()
    q.stop()
    assert sum(kept) == spark.read.parquet(src).where(f"ts >= '{limit}'").count()


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir("/root/testdata/sf0.001"):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '/root/testdata/sf0.001/{name}'")
    return c


def comparable(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict"):
        return {k: comparable(x) for k, x in v.asDict().items()}
    return [comparable(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_agree_with_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    want = tables.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(str, map(comparable, got))) == sorted(map(str, map(comparable, want)))


def test_whole_powers_are_exact(collection):
    docs = [{"b": b} for b in (3, -3, 0, 1, -1, 2)]
    got = collection(docs).aggregate([{"$project": {"p": {"$pow": ["$b", 39]}, "q": {"$pow": [{"$mod": ["$b", 2]}, 101]}, "z": {"$pow": ["$b", 0]}}}]).to_list()
    assert [(r["p"], r["q"], r["z"]) for r in got] == [(d["b"] ** 39, (abs(d["b"]) % 2) * (1 if d["b"] > 0 else -1), 1) for d in docs]


#: Seconds: within the hours that New York and Sao Paulo skip in spring, before the epoch, past year 9,999 and 33,658, none.
MOMENTS = {1173581290: "2007-03-11T02:48:10Z", 1540087200: "2018-10-21T02:00:00Z", 1541293200: "2018-11-04T01:00:00Z", -62167219200: "0000-01-01T00:00:00Z", -62167219201: "-1-12-31T23:59:59Z", -1: "1969-12-31T23:59:59Z", 253402300800: "10000-01-01T00:00:00Z", 1001881985856: "33718-05-18T07:37:36Z", None: None}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "America/Sao_Paulo"])
def test_dates_are_those_of_utc_in_any_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame(list(enumerate(MOMENTS)), "id long, s long").selectExpr("id", "timestamp_seconds(s) AS at", "timestamp_millis(s * 1000 + 50) AS ms", "date_from_unix_date(CAST(floor(s / 86400) AS INT)) AS day", "timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(CAST(floor(s / 86400) AS INT), 0, 0, CAST(pmod(s, 86400) AS DECIMAL(18, 6))) AS free")
        made = Collection(rows, "id", plain=True).aggregate([{"$project": {"t": {"$toString": "$at"}, "ms": {"$toString": "$ms"}, "day": {"$toString": "$day"}, "free": {"$toString": "$free"}, "y": {"$year": "$at"}, "h": {"$hour": "$at"}, "dh": {"$hour": "$day"}, "m": {"$millisecond": "$ms"}}}]).df
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for got, want in zip(made.orderBy("id").collect(), MOMENTS.values()):
        if want is None:
            assert all(x is None for x in got[1:])
        else:
            assert (got.t, got.ms, got.day, got.free) == (want, want[:-1] + ".050Z", want.split("T")[0] + "T00:00:00Z", want)
            assert (got.y, got.h, got.dh, got.m) == (int(want[:-16]), int(want.split("T")[1][:2]), 0, 50)


@pytest.mark.parametrize("ids", [[0, 29330, 30116, 31703], [6332940, 6333000, 7_000_000], [26546070, -5], [3, None]])
def test_dates_in_another_zone_agree_with_sql(spark, tmp_path, ids):
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    name = "expr_dates_in_another_zone"
    df = queries.QUERIES[name](spark, str(tmp_path))
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    want = duckdb.connect().execute(f"WITH events AS (SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')) {queries.ORACLES[name]}").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    assert "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()  # the scan itself: no rows came by the driver


def test_missing_values_are_not_collected(collection):
    docs = [{"g": 1, "v": None}, {"g": 1, "v": 3}, {"g": 1, "v": None}, {"g": 1, "v": 2}, {"g": 2, "v": None}]
    spec = {"_id": "$g", "p": {"$push": "$v"}, "s": {"$addToSet": "$v"}, "f": {"$firstN": {"input": "$v", "n": 1}}, "l": {"$lastN": {"input": "$v", "n": 5}}}
    got = {r["_id"]: (r["p"], r["s"], r["f"], r["l"]) for r in collection(docs, plain=True).aggregate([{"$group": spec}]).to_list()}
    assert got == {1: ([3, 2], [2, 3], [3], [3, 2]), 2: ([], [], [], [])}
    kept = {r["_id"]: r["p"] for r in collection(docs).aggregate([{"$group": {"_id": "$g", "p": {"$push": "$v"}}}]).to_list()}
    assert kept == {1: [None, 3, None, 2], 2: [None]}


def test_values_of_a_group_are_bounded(spark, collection):
    nan = float("nan")
    docs = [{"g": (None, "a", "b")[i % 3], "v": (None, 1.5, -2.0, nan, 7.0, 1.5)[i * 7 % 6], "t": i * 5 % 4, "i": i} for i in range(40)]
    spec = {"f": {"$firstN": {"input": "$v", "n": 4}}, "l": {"$lastN": {"input": "$v", "n": 3}}, "lo": {"$minN": {"input": "$v", "n": 9}}, "n": {"$count": {}}, "hi": {"$maxN": {"input": "$v", "n": 2}}, "values": {"$maxN": {"input": "$i", "n": 50}}, "none": {"$minN": {"input": "$zz", "n": 1}}}

    def expected(rows):
        at = [d["v"] for d in sorted(rows, key=lambda d: (-d["t"], d["i"]))]
        held = sorted((v for v in at if v is not None), key=lambda v: (v == v, v if v == v else 0))
        return {"f": at[:4], "l": at[-3:], "lo": held[:9], "n": len(rows), "hi": held[::-1][:2], "values": sorted((d["i"] for d in rows), reverse=True)[:50], "none": []}

    c = collection(docs)
    got = c.aggregate([{"$sort": {"t": -1}}, {"$group": {"_id": "$g"} | spec}]).to_list()
    assert {d["_id"] for d in got} == {None, "a", "b"} and list(got[0]) == ["_id", *spec]
    for d in got:
        assert repr({k: v for k, v in d.items() if k != "_id"}) == repr(expected([x for x in docs if x["g"] == d["_id"]]))
    whole = c.aggregate([{"$sort": {"t": -1}}, {"$group": {"_id": None} | spec}]).to_list()
    assert repr(whole) == repr([{"_id": None} | expected(docs)])
    assert c.aggregate([{"$match": {"i": -1}}, {"$group": {"_id": None} | spec}]).to_list() == []
    assert c.aggregate([{"$match": {"i": -1}}, {"$group": {"_id": "$g"} | spec}]).to_list() == []
    plan = c.aggregate([{"$group": {"_id": "$g", "f": {"$firstN": {"input": "$v", "n": 4}}}}]).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
