import datetime as dt
import re

import pytest

from folio.errors import BadValue, UnsupportedOperator

NAN = float("nan")
DOCS = [
    {"a": 1, "f": 1.5, "s": "apple", "n": {"x": 1, "y": "p"}, "t": [1, 5], "o": [{"k": "b", "v": 1}, {"k": "c", "v": 7}], "b": True, "d": dt.datetime(2021, 1, 1)},
    {"a": 7, "f": NAN, "s": "Bpple\n", "n": {"x": 2, "y": "q"}, "t": [], "o": [], "b": False, "d": dt.datetime(2021, 3, 15, 13, 45, 30, 250000)},
    {"a": None, "f": None, "s": None, "n": None, "t": None, "o": None, "b": None, "d": None},
    {"a": -3, "f": -0.0, "s": "cherry", "n": {"x": None, "y": None}, "t": [None, 2], "o": [{"k": "b", "v": 9}], "b": True, "d": dt.datetime(1970, 1, 1)},
]

CASES = [
    ({}, [0, 1, 2, 3]),
    ({"a": 1}, [0]),
    ({"a": 1.0}, [0]),
    ({"a": None}, [2]),
    ({"zz": None}, [0, 1, 2, 3]),
    ({"zz": 1}, []),
    ({"zz": {"$ne": 1}}, [0, 1, 2, 3]),
    ({"a": {"$ne": 1}}, [1, 2, 3]),
    ({"a": {"$gt": 0}}, [0, 1]),
    ({"a": {"$lt": 5}}, [0, 2, 3]),
    ({"a": {"$lte": None}}, [2]),
    ({"a": {"$lt": "z"}}, [0, 1, 2, 3]),
    ({"a": {"$gt": "z"}}, []),
    ({"s": {"$gt": 5}}, [0, 1, 3]),
    ({"f": {"$lt": -100}}, [1, 2]),
    ({"f": {"$gt": 0}}, [0]),
    ({"f": 0}, [3]),
    ({"f": NAN}, [1]),
    ({"a": {"$in": [1, None, "x"]}}, [0, 2]),
    ({"a": {"$in": []}}, []),
    ({"a": {"$nin": [1, 7]}}, [2, 3]),
    ({"t": 5}, [0]),
    ({"t": [1, 5]}, [0]),
    ({"t": []}, [1]),
    ({"t": None}, [2, 3]),
    ({"t": {"$gt": 4}}, [0]),
    ({"t.1": 5}, [0]),
    ({"t.1": {"$gte": 2}}, [0, 3]),
    ({"t": {"$size": 2}}, [0, 3]),
    ({"t": {"$all": [1, 5]}}, [0]),
    ({"t": {"$all": []}}, []),
    ({"a": {"$all": [1]}}, [0]),
    ({"t": {"$elemMatch": {"$gt": 1, "$lt": 3}}}, [3]),
    ({"o": {"$elemMatch": {"k": "b", "v": {"$gt": 5}}}}, [3]),
    ({"o": {"$all": [{"$elemMatch": {"k": "b"}}, {"$elemMatch": {"v": 7}}]}}, [0]),
    ({"o.k": "b"}, []),
    ({"n.x": 1}, [0]),
    ({"n": {"x": 1, "y": "p"}}, [0]),
    ({"n.x": {"$exists": True}}, [0, 1, 2, 3]),
    ({"n.q": {"$exists": False}}, [0, 1, 2, 3]),
    ({"$or": [{"a": 1}, {"s": "cherry"}]}, [0, 3]),
    ({"$nor": [{"a": 1}, {"a": None}]}, [1, 3]),
    ({"$and": []}, [0, 1, 2, 3]),
    ({"a": {"$not": {"$gt": 0}}}, [2, 3]),
    ({"a": {"$mod": [4, 3]}}, [1]),
    ({"a": {"$mod": [4, -3]}}, [3]),
    ({"f": {"$mod": [2, 1]}}, [0]),
    ({"a": {"$bitsAllSet": 5}}, [1, 3]),
    ({"a": {"$bitsAnySet": [1, 200]}}, [1, 3]),
    ({"a": {"$bitsAllClear": [3]}}, [0, 1]),
    ({"a": {"$bitsAnyClear": b"\x06"}}, [0, 3]),
    ({"s": {"$regex": "^.pple$", "$options": "i"}}, [0]),
    ({"s": re.compile("PPL", re.I)}, [0, 1]),
    ({"s": {"$regex": "^Bpple$", "$options": "m"}}, [1]),
    ({"a": {"$type": ["long", "null"]}}, [0, 1, 2, 3]),
    ({"a": {"$type": 2}}, []),
    ({"b": True}, [0, 3]),
    ({"d": {"$lt": dt.datetime(2021, 1, 1)}}, [2, 3]),
    ({"$expr": {"$gt": ["$a", "$f"]}}, [1]),
    ({"$comment": "x", "a": 7}, [1]),
]


@pytest.mark.parametrize("query,want", CASES, ids=[str(c[0])[:60] for c in CASES])
def test_matches(collection, query, want):
    c = collection(DOCS)
    assert sorted(d["_id"] for d in c.find(query).run()) == want
    assert c.count_documents(query) == len(want)
    # A filter and its negation part the documents.
    assert c.count_documents({"$nor": [query]}) == len(DOCS) - len(want)


@pytest.mark.parametrize(
    "query,error",
    [
        ({"$or": []}, BadValue), ({"$not": {"a": 1}}, BadValue), ({"a": {"$not": {}}}, BadValue), ({"a": {"$in": 1}}, BadValue), ({"a": {"$size": -1}}, BadValue), ({"a": {"$mod": [0, 1]}}, BadValue),
        ({"a": {"$mod": [1]}}, BadValue), ({"s": {"$regex": "(?=a)"}}, BadValue), ({"s": {"$regex": "a", "$options": "q"}}, BadValue), ({"a": {"$bitsAllSet": -1}}, BadValue), ({"a": {"$type": "number"}}, BadValue),
        ({"$where": "1"}, UnsupportedOperator), ({"a": {"$near": 1}}, UnsupportedOperator), ({"a": {"$comment": 1}}, UnsupportedOperator), ({"a": {"$options": "i"}}, BadValue), ({"a": {"$exists": "x"}}, BadValue),
    ],
)
def test_errors(collection, query, error):
    with pytest.raises(error):
        collection(DOCS).find(query).to_df()


def test_null_is_missing_in_plain_collections(collection):
    c = collection(DOCS, plain=True)
    assert [d["_id"] for d in c.find({"a": {"$lt": 5}}).sort({"_id": 1}).run()] == [0, 3]
    assert c.count_documents({"a": {"$exists": False}}) == 1


def test_ranges_reach_the_scan(spark):
    from folio import Collection

    c = Collection.from_parquet(spark, "/root/testdata/sf0.001/orders.parquet", "o_orderkey", plain=True)
    pushed = c.explain({"o_totalprice": {"$lt": 5000.0}, "o_orderstatus": {"$in": ["O", "F"]}, "o_custkey": 3})["pushed_filters"]
    assert {"LessThan(o_totalprice,5000.0)", "EqualTo(o_custkey,3)"} <= set(pushed)
    assert any(p.startswith("In(o_orderstatus") for p in pushed)


def test_long_lists(collection):
    import datetime as dt

    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=k) for k in range(4000)]
    docs = [{"d": k / 2, "n": k, "t": days[k], "a": [k, k + 1], "s": str(k)} for k in range(20)]
    c = collection(docs)
    many = [k / 2 for k in range(10, 4000)]
    for query, want in (({"d": {"$in": many}}, 10), ({"d": {"$nin": many}}, 10), ({"t": {"$in": days[5:]}}, 15), ({"a": {"$in": list(range(10, 4000))}}, 11), ({"n": {"$in": [*many[:150], *map(str, range(150))]}}, 15), ({"s": {"$in": list(map(str, range(15, 3000)))}}, 5)):
        assert c.count_documents(query) == want, query
