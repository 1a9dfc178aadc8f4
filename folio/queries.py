"""Registered document queries over the benchmark tables, each with the SQL that it must agree with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .client import Collection, Database
from .operators.frame import Frame
from .operators.update import apply_update, update_rows
from .sources import indexes

IDS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey",
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables(Database):
    """A database over a folder of Parquet tables, whose numbers hold no NaN and whose fields are never null."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__(spark, "bench")
        self.sf_dir = sf_dir

    def get(self, name: str) -> Collection | None:
        if name in IDS and name not in self._held:
            self.register(name, self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), IDS[name], plain=True)
        return self._held.get(name)


def query(name: str, sql: str, make: Callable[[Tables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    ORACLES[name] = sql


def pipeline(name: str, table: str, stages: list[dict], sql: str) -> None:
    query(name, sql, lambda t: t[table].aggregate(stages).df)


def found(name: str, table: str, where: dict, sql: str, columns: list[str] | None = None) -> None:
    """A filter; the identifier and the columns of what it finds."""
    query(name, sql, lambda t: t[table].find(where).to_df().select(*(columns or [IDS[table]])))


# -- filters

found("filter_eq", "orders", {"o_orderstatus": "F"}, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
found("filter_ne_nin", "orders", {"o_orderstatus": {"$ne": "F"}, "o_orderpriority": {"$nin": ["1-URGENT", "2-HIGH"]}}, "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
found("filter_range_and_in", "orders", {"o_totalprice": {"$gte": 100000, "$lt": 200000.5}, "o_orderpriority": {"$in": ["1-URGENT", "5-LOW"]}}, "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000.5 AND o_orderpriority IN ('1-URGENT', '5-LOW')")
found("filter_dates", "orders", {"o_orderdate": {"$gte": dt.datetime(1995, 1, 1), "$lte": dt.datetime(1996, 12, 31)}}, "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
found("filter_logic", "customer", {"$or": [{"c_acctbal": {"$lt": 0}}, {"c_mktsegment": "BUILDING"}], "$nor": [{"c_nationkey": 3}, {"c_nationkey": {"$gt": 20}}], "$comment": "any"}, "SELECT c_custkey FROM customer WHERE (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AND NOT (c_nationkey = 3 OR c_nationkey > 20)")
found("filter_not", "customer", {"c_acctbal": {"$not": {"$gt": 5000}}, "$and": [{"c_nationkey": {"$gte": 5}}, {"c_nationkey": {"$lte": 9}}]}, "SELECT c_custkey FROM customer WHERE NOT c_acctbal > 5000 AND c_nationkey BETWEEN 5 AND 9")
found("filter_mod", "part", {"p_size": {"$mod": [7, 3]}, "p_retailprice": {"$mod": [4, 1]}}, "SELECT p_partkey FROM part WHERE p_size % 7 = 3 AND CAST(trunc(p_retailprice) AS BIGINT) % 4 = 1")
found("filter_bits", "part", {"p_size": {"$bitsAllSet": 5, "$bitsAnyClear": [1, 3]}, "p_partkey": {"$bitsAnySet": 6, "$bitsAllClear": [3, 70]}}, "SELECT p_partkey FROM part WHERE (p_size & 5) = 5 AND (p_size & 10) <> 10 AND (p_partkey & 6) <> 0 AND (p_partkey & 8) = 0")
found("filter_regex", "part", {"p_name": {"$regex": "^(small|RED).*(bolt|widget)$", "$options": "i"}}, "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(small|RED).*(bolt|widget)$', 'i')")
query("filter_exists", "SELECT event_id FROM events WHERE user_id % 3 <> 0 AND event_type <> 'view'", lambda t: _with_nulls(t).find({"u": {"$exists": True}, "kind": {"$exists": 1}, "absent": {"$exists": False}}).to_df().select("event_id"))
query("filter_not_exists", "SELECT event_id FROM events WHERE user_id % 3 = 0", lambda t: _with_nulls(t).find({"u": {"$exists": False}}).to_df().select("event_id"))
query("filter_type", "SELECT event_id FROM events WHERE user_id % 3 <> 0 AND event_type <> 'view'", lambda t: _with_nulls(t).find({"u": {"$type": ["long", "string"]}, "kind": {"$type": 2}, "value": {"$not": {"$type": "int"}}}).to_df().select("event_id"))
query("filter_type_null", "SELECT event_id FROM events WHERE user_id % 3 = 0 OR event_type = 'view'", lambda t: _with_nulls(t, False).find({"$or": [{"u": {"$type": "null"}}, {"kind": {"$type": ["null", "bool"]}}]}).to_df().select("event_id"))
query("filter_type_rank", "SELECT event_id FROM events WHERE user_id % 3 = 0 AND event_type <> 'view'", lambda t: _with_nulls(t, False).find({"u": {"$lt": -(10**9)}, "kind": {"$gt": 10**9}, "value": {"$lt": "z"}, "gone": None}).to_df().select("event_id"))
found("filter_in_many", "part", {"p_retailprice": {"$in": [900 + k / 10 for k in range(0, 20_000, 7)]}}, "SELECT p_partkey FROM part WHERE list_contains(list_transform(range(0, 20000, 7), lambda k: 900 + k / 10), p_retailprice)")
found("filter_expr", "lineitem", {"$expr": {"$gt": [{"$multiply": ["$l_extendedprice", "$l_discount"]}, {"$add": ["$l_quantity", 3000]}]}}, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * l_discount > l_quantity + 3000", ["l_orderkey", "l_linenumber"])
found("filter_array", "embeddings", {"embedding": {"$size": 64, "$elemMatch": {"$gt": 0.25, "$lt": 0.3}}, "embedding.0": {"$gt": 0}}, "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x > 0.25 AND x < 0.3)) > 0 AND embedding[1] > 0")
query("filter_array_words", "SELECT doc_id FROM documents WHERE list_has_all(string_split(text, ' '), ['the', 'of'])", lambda t: _then(t, "documents", [{"$addFields": {"words": {"$split": ["$text", " "]}}}, {"$match": {"words": {"$all": ["the", "of"]}}}]).df.select("doc_id"))


def _with_nulls(t: Tables, plain: bool = True) -> Collection:
    """Events whose user is null for every third of them, and whose type is where they are views."""
    df = t["events"].df().select("event_id", "value", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("u"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    return Collection(df, "event_id", plain=plain)


def _then(t: Tables, table: str, stages: list[dict]) -> Frame:
    from .operators.stages import run_pipeline

    return run_pipeline(t[table].frame(), stages)


# -- find, count, distinct

query("find_sort_skip_limit", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10", lambda t: t["orders"].find({"o_orderstatus": "O"}).sort({"o_totalprice": -1}).skip(10).limit(50).projection({"o_totalprice": 1, "o_orderdate": 1}).to_df())
query("find_exclude", "SELECT c_name, c_acctbal FROM customer WHERE c_nationkey = 7", lambda t: t["customer"].find({"c_nationkey": 7}).projection({"_id": 0, "c_nationkey": 0, "c_mktsegment": False}).to_df())
query("find_nested_projection", "SELECT event_id, {'k': CAST(json_extract(props, '$.k') AS BIGINT)} AS p FROM events", lambda t: _nested(t).find().projection({"p.k": 1}).to_df())
query("distinct_values", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_totalprice > 50000", lambda t: t["orders"].distinct_df("o_orderpriority", {"o_totalprice": {"$gt": 50000}}))
query("distinct_of_arrays", "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS value FROM part", lambda t: Collection(_then(t, "part", [{"$addFields": {"words": {"$split": ["$p_type", " "]}}}]).df, "p_partkey", plain=True).distinct_df("words"))
pipeline("count_stage", "lineitem", [{"$match": {"l_quantity": {"$gt": 45}}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 45")


def _nested(t: Tables) -> Collection:
    df = t["events"].df().select("event_id", F.struct(F.from_json("props", "k bigint")["k"].alias("k"), F.col("value").alias("v")).alias("p"))
    return Collection(df, "event_id", plain=True)


# -- groups and accumulators

REVENUE = {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}
pipeline(
    "group_revenue_by_flag", "lineitem",
    [{"$group": {"_id": "$l_returnflag", "revenue": REVENUE, "n": {"$count": {}}}}, {"$project": {"revenue": {"$round": ["$revenue", 2]}, "n": 1}}, {"$sort": {"_id": 1}}],
    "SELECT l_returnflag AS _id, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1",
)
pipeline(
    "group_pricing_summary", "lineitem",
    [{"$match": {"l_shipdate": {"$lte": dt.datetime(1998, 9, 2)}}}, {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "qty": {"$sum": "$l_quantity"}, "price": {"$avg": "$l_extendedprice"}, "lo": {"$min": "$l_discount"}, "hi": {"$max": "$l_tax"}, "n": {"$sum": 1}}},
     {"$project": {"_id": 0, "flag": "$_id.flag", "status": "$_id.status", "qty": {"$round": ["$qty", 2]}, "price": {"$round": ["$price", 4]}, "lo": 1, "hi": 1, "n": 1}}],
    "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS lo, max(l_tax) AS hi, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
)
pipeline(
    "group_null_id", "orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "lo": {"$min": "$o_orderdate"}, "hi": {"$max": "$o_orderkey"}}}, {"$project": {"_id": 0, "n": 1, "lo": 1, "hi": 1}}],
    "SELECT count(*) AS n, min(o_orderdate) AS lo, max(o_orderkey) AS hi FROM orders",
)
pipeline(
    "group_first_last", "events",
    [{"$sort": {"ts": 1}}, {"$group": {"_id": "$user_id", "first": {"$first": "$event_id"}, "last": {"$last": "$event_type"}}}],
    "SELECT user_id AS _id, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1",
)
pipeline(
    "group_falling_order", "events",
    [{"$sort": {"event_type": -1, "value": -1}}, {"$group": {"_id": "$user_id", "top": {"$first": "$event_id"}}}],
    "SELECT user_id AS _id, first(event_id ORDER BY event_type DESC, value DESC, event_id) AS top FROM events GROUP BY 1",
)
pipeline(
    "group_push", "conversations",
    [{"$sort": {"turn": 1}}, {"$group": {"_id": "$conv_id", "roles": {"$push": "$role"}, "kinds": {"$addToSet": "$role"}}}],
    "SELECT conv_id AS _id, array_agg(role ORDER BY turn) AS roles, list_sort(array_agg(DISTINCT role)) AS kinds FROM conversations GROUP BY 1",
)
pipeline(
    "group_n_values", "events",
    [{"$sort": {"ts": 1}}, {"$group": {"_id": "$event_type", "f": {"$firstN": {"input": "$event_id", "n": 3}}, "l": {"$lastN": {"input": "$event_id", "n": 2}}, "lo": {"$minN": {"input": "$value", "n": 2}}, "hi": {"$maxN": {"input": "$value", "n": 2}}}}],
    "SELECT event_type AS _id, array_agg(event_id ORDER BY ts, event_id)[1:3] AS f, array_agg(event_id ORDER BY ts, event_id)[-2:] AS l, list_sort(array_agg(value))[1:2] AS lo, list_reverse_sort(array_agg(value))[1:2] AS hi FROM events GROUP BY 1",
)
pipeline(
    "group_deviation", "events", [{"$group": {"_id": "$event_type", "p": {"$stdDevPop": "$value"}, "s": {"$stdDevSamp": "$value"}}}, {"$addFields": {"p": {"$round": ["$p", 6]}, "s": {"$round": ["$s", 6]}}}],
    "SELECT event_type AS _id, round(stddev_pop(value), 6) AS p, round(stddev_samp(value), 6) AS s FROM events GROUP BY 1",
)
query(
    "group_merge_objects",
    "SELECT user_id AS _id, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS k FROM events GROUP BY 1",
    lambda t: Collection(t["events"].df().select("event_id", "user_id", F.from_json("props", "k bigint").alias("p")), "event_id").aggregate([{"$group": {"_id": "$user_id", "o": {"$mergeObjects": "$p"}}}, {"$project": {"k": "$o.k"}}]).df,
)
pipeline("sort_by_count", "events", [{"$sortByCount": "$event_type"}], "SELECT event_type AS _id, count(*) AS count FROM events GROUP BY 1")
pipeline(
    "group_distinct_count", "orders", [{"$group": {"_id": "$o_orderpriority", "c": {"$addToSet": "$o_custkey"}}}, {"$project": {"n": {"$size": "$c"}}}],
    "SELECT o_orderpriority AS _id, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1",
)

# -- projections and computed fields

pipeline(
    "project_computed", "customer", [{"$project": {"name": "$c_name", "tier": {"$switch": {"branches": [{"case": {"$gte": ["$c_acctbal", 8000]}, "then": "gold"}, {"case": {"$gte": ["$c_acctbal", 3000]}, "then": "silver"}], "default": "basic"}}, "debt": {"$cond": [{"$lt": ["$c_acctbal", 0]}, {"$abs": "$c_acctbal"}, 0]}}}],
    "SELECT c_custkey, c_name AS name, CASE WHEN c_acctbal >= 8000 THEN 'gold' WHEN c_acctbal >= 3000 THEN 'silver' ELSE 'basic' END AS tier, CASE WHEN c_acctbal < 0 THEN abs(c_acctbal) ELSE 0.0 END::DOUBLE AS debt FROM customer",
)
pipeline("add_fields_snapshot", "orders", [{"$addFields": {"o_custkey": "$o_orderkey", "o_orderkey2": "$o_custkey"}}, {"$unset": ["o_orderdate", "o_totalprice"]}], "SELECT o_orderkey, o_orderkey AS o_custkey, o_orderstatus, o_orderpriority, o_custkey AS o_orderkey2 FROM orders")
pipeline("set_skip_limit", "part", [{"$sort": {"p_retailprice": -1}}, {"$skip": 5}, {"$limit": 20}, {"$set": {"half": {"$divide": ["$p_retailprice", 2]}}}, {"$project": {"half": 1, "p_brand": 1}}], "SELECT p_partkey, p_brand, p_retailprice / 2 AS half FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 5")
pipeline("replace_root", "nation", [{"$replaceRoot": {"newRoot": {"_id": "$n_nationkey", "label": {"$concat": ["$n_name", "/", {"$toString": "$n_regionkey"}]}}}}], "SELECT n_nationkey AS _id, n_name || '/' || CAST(n_regionkey AS VARCHAR) AS label FROM nation")
pipeline("replace_with", "orders", [{"$addFields": {"d": {"k": "$o_orderkey", "s": "$o_orderstatus"}}}, {"$replaceWith": "$d"}], "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders")
pipeline(
    "expr_strings", "part",
    [{"$project": {"u": {"$toUpper": "$p_name"}, "l": {"$toLower": "$p_brand"}, "n": {"$strLenCP": "$p_type"}, "sub": {"$substrCP": ["$p_name", 2, 5]}, "first": {"$arrayElemAt": [{"$split": ["$p_type", " "]}, 0]}, "t": {"$trim": {"input": {"$concat": ["  ", "$p_brand", "\t"]}}}, "r": {"$rtrim": {"input": "$p_type", "chars": "LESTN"}}}}],
    "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_type) AS n, substring(p_name, 3, 5) AS sub, split_part(p_type, ' ', 1) AS first, p_brand AS t, rtrim(p_type, 'LESTN') AS r FROM part",
)
pipeline(
    "expr_math", "lineitem",
    [{"$group": {"_id": {"o": "$l_orderkey", "n": "$l_linenumber"}, "q": {"$sum": "$l_quantity"}, "p": {"$max": "$l_extendedprice"}, "d": {"$min": "$l_discount"}}},
     {"$project": {"_id": 0, "o": "$_id.o", "n": "$_id.n", "m": {"$mod": ["$_id.o", 7]}, "pw": {"$pow": ["$_id.n", 2]}, "sq": {"$round": [{"$sqrt": "$q"}, 6]}, "ce": {"$ceil": "$p"}, "fl": {"$floor": "$p"}, "tr": {"$trunc": {"$multiply": ["$p", -1]}}, "ro": {"$round": ["$p", -2]}, "ln": {"$round": [{"$ln": "$p"}, 6]}, "lg": {"$round": [{"$log10": "$p"}, 6]}, "ex": {"$round": [{"$exp": "$d"}, 6]}}}],
    "WITH g AS (SELECT l_orderkey AS o, l_linenumber AS n, sum(l_quantity) AS q, max(l_extendedprice) AS p, min(l_discount) AS d FROM lineitem GROUP BY 1, 2) SELECT o, n, o % 7 AS m, CAST(n * n AS BIGINT) AS pw, round(sqrt(q), 6) AS sq, ceil(p) AS ce, floor(p) AS fl, trunc(-p) AS tr, round_even(p * 0.01, 0) / 0.01 AS ro, round(ln(p), 6) AS ln, round(log10(p), 6) AS lg, round(exp(d), 6) AS ex FROM g",
)
pipeline(
    "expr_dates", "orders",
    [{"$project": {"y": {"$year": "$o_orderdate"}, "m": {"$month": "$o_orderdate"}, "d": {"$dayOfMonth": "$o_orderdate"}, "w": {"$dayOfWeek": "$o_orderdate"}, "j": {"$dayOfYear": "$o_orderdate"}, "h": {"$hour": "$o_orderdate"}, "mi": {"$minute": "$o_orderdate"}, "s": {"$second": "$o_orderdate"}, "ms": {"$millisecond": "$o_orderdate"}, "next": {"$add": ["$o_orderdate", 86400000]}, "since": {"$subtract": ["$o_orderdate", dt.datetime(1992, 1, 1)]}, "text": {"$toString": "$o_orderdate"}}}],
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) + 1 AS w, dayofyear(o_orderdate) AS j, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, CAST(epoch_ms(o_orderdate) % 1000 AS BIGINT) AS ms, o_orderdate + INTERVAL 1 DAY AS next, epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1992-01-01') AS since, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS text FROM orders",
)
pipeline(
    "expr_arrays", "embeddings",
    [{"$project": {"first": {"$first": "$embedding"}, "last": {"$last": "$embedding"}, "third": {"$arrayElemAt": ["$embedding", -3]}, "n": {"$size": {"$filter": {"input": "$embedding", "as": "x", "cond": {"$gt": ["$$x", 0]}}}}, "head": {"$map": {"input": {"$slice": ["$embedding", 3]}, "in": {"$round": [{"$multiply": ["$$this", 10]}, 2]}}}, "has": {"$in": [5, {"$range": [1, 9, 2]}]}, "r": {"$range": [5, 0, -2]}, "both": {"$concatArrays": [[1, 2], {"$range": [3, 5]}]}, "is": {"$isArray": "$embedding"}, "mid": {"$size": {"$slice": ["$embedding", -10, 4]}}}}],
    "SELECT vec_id, embedding[1] AS first, embedding[-1] AS last, embedding[-3] AS third, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n, list_transform(embedding[1:3], lambda x: round_even(CAST(x AS DOUBLE) * 10 * 100, 0) / 100) AS head, true AS has, [5, 3, 1]::BIGINT[] AS r, [1, 2, 3, 4]::BIGINT[] AS both, true AS is, 4::BIGINT AS mid FROM embeddings",
)
pipeline(
    "expr_types", "events",
    [{"$project": {"t": {"$type": "$value"}, "none": {"$type": "$nothing"}, "i": {"$toInt": "$value"}, "l": {"$toLong": {"$toString": "$user_id"}}, "dbl": {"$toDouble": "$event_id"}, "b": {"$toBool": "$user_id"}, "when": {"$toDate": {"$multiply": ["$event_id", 1000]}}, "nul": {"$ifNull": ["$nothing", "$event_type"]}, "c": {"$cmp": ["$user_id", 50]}, "lit": {"$literal": "$x"}, "logic": {"$and": [{"$or": ["$user_id", False]}, {"$not": [{"$eq": ["$event_type", "zzz"]}]}]}}}],
    "SELECT event_id, 'double' AS t, 'missing' AS none, CAST(trunc(value) AS INTEGER) AS i, user_id AS l, CAST(event_id AS DOUBLE) AS dbl, user_id <> 0 AS b, epoch_ms(event_id * 1000) AS when, event_type AS nul, CAST(sign(user_id - 50) AS BIGINT) AS c, '$x' AS lit, user_id <> 0 AS logic FROM events",
)

pipeline("expr_pow_whole", "part", [{"$project": {"a": {"$pow": ["$p_size", 11]}, "b": {"$pow": [{"$add": [{"$mod": ["$p_partkey", 3]}, 1]}, 39]}, "z": {"$pow": ["$p_size", 0]}, "h": {"$pow": ["$p_size", 0.5]}}}], "SELECT p_partkey, CAST(CAST(p_size AS HUGEINT) * p_size * p_size * p_size * p_size * p_size * p_size * p_size * p_size * p_size * p_size AS BIGINT) AS a, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 549755813888 ELSE 4052555153018976267 END AS b, 1::BIGINT AS z, pow(p_size, 0.5) AS h FROM part")
query("expr_dates_in_another_zone", "SELECT event_id, hour(m) AS h, day(m) AS d, strftime(m, '%Y-%m-%dT%H:%M:%SZ') AS text FROM (SELECT event_id, make_timestamp(event_id * 40013 * 1000000) AS m FROM events)", lambda t: _in_zone(t, [{"$project": {"h": {"$hour": "$at"}, "d": {"$dayOfMonth": "$at"}, "text": {"$toString": "$at"}}}]))
query("group_of_missing", "SELECT user_id AS _id, coalesce(array_agg(kind ORDER BY event_id) FILTER (kind IS NOT NULL), []) AS kinds, coalesce(list_sort(array_agg(DISTINCT kind) FILTER (kind IS NOT NULL)), []) AS some, coalesce((array_agg(kind ORDER BY event_id) FILTER (kind IS NOT NULL))[1:2], []) AS two FROM (SELECT event_id, user_id, nullif(event_type, 'view') AS kind FROM events) GROUP BY 1", lambda t: Collection(t["events"].df().select("event_id", "user_id", F.expr("nullif(event_type, 'view') AS kind")), "event_id", plain=True).aggregate([{"$group": {"_id": "$user_id", "kinds": {"$push": "$kind"}, "some": {"$addToSet": "$kind"}, "two": {"$firstN": {"input": "$kind", "n": 2}}}}]).df)
pipeline("expr_ltrim_rand", "part", [{"$project": {"l": {"$ltrim": {"input": "$p_brand", "chars": "Brand#"}}, "r": {"$rand": {}}}}, {"$project": {"l": 1, "r": {"$and": [{"$gte": ["$r", 0]}, {"$lt": ["$r", 1]}]}}}], "SELECT p_partkey, ltrim(p_brand, 'Brand#') AS l, true AS r FROM part")


def _in_zone(t: Tables, stages: list[dict]) -> DataFrame:
    """The stages compiled while the session is in another zone, which Spark fixes in a plan as it is made; run like any other."""
    zone = t.spark.conf.get("spark.sql.session.timeZone")
    t.spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        events = t["events"].df().select("event_id", F.timestamp_seconds(F.col("event_id") * 40013).alias("at"))
        return Collection(events, "event_id", plain=True).aggregate(stages).df
    finally:
        t.spark.conf.set("spark.sql.session.timeZone", zone)


# -- unwind and lookup

pipeline("unwind_words", "part", [{"$project": {"w": {"$split": ["$p_type", " "]}}}, {"$unwind": {"path": "$w", "includeArrayIndex": "i"}}, {"$group": {"_id": {"w": "$w", "i": "$i"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "w": "$_id.w", "i": "$_id.i", "n": 1}}], "SELECT w, i, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) - 1 AS i FROM part) GROUP BY 1, 2")
WORDS_OF_NAMES = {"$split": ["$p_name", " "]}
pipeline("unwind_several", "part", [{"$project": {"w": WORDS_OF_NAMES}}, {"$unwind": {"path": "$w", "includeArrayIndex": "i"}}], "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part")
pipeline("unwind_preserve", "part", [{"$project": {"w": {"$filter": {"input": WORDS_OF_NAMES, "cond": {"$in": ["$$this", ["small", "bolt"]]}}}}}, {"$unwind": {"path": "$w", "preserveNullAndEmptyArrays": True}}], "SELECT p_partkey, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS w FROM (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x IN ('small', 'bolt')) AS f FROM part)")
pipeline("lookup_array", "nation", [{"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "c"}}, {"$project": {"n": {"$size": "$c"}, "names": {"$slice": ["$c.c_name", 0]} if False else {"$size": {"$filter": {"input": "$c", "cond": {"$gt": ["$$this.c_acctbal", 5000]}}}}}}], "SELECT n_nationkey, count(c_custkey) AS n, count(*) FILTER (c_acctbal > 5000) AS names FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
pipeline(
    "lookup_unwind_join", "orders",
    [{"$match": {"o_orderdate": {"$gte": dt.datetime(1996, 1, 1)}}}, {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$lookup": {"from": "nation", "localField": "c.c_nationkey", "foreignField": "n_nationkey", "as": "n"}}, {"$unwind": "$n"},
     {"$group": {"_id": "$n.n_name", "total": {"$sum": "$o_totalprice"}, "orders": {"$count": {}}}}, {"$addFields": {"total": {"$round": ["$total", 2]}}}],
    "SELECT n_name AS _id, round(sum(o_totalprice), 2) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1",
)
pipeline("lookup_left_join", "documents", [{"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "l"}}, {"$unwind": {"path": "$l", "preserveNullAndEmptyArrays": True}}, {"$project": {"q": {"$ifNull": ["$l.quality", -1]}, "source": 1}}], "SELECT d.doc_id, d.source, coalesce(CAST(l.quality AS BIGINT), -1) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
pipeline("lookup_anti", "customer", [{"$addFields": {"k": {"$add": ["$c_custkey", 1490]}}}, {"$lookup": {"from": "orders", "localField": "k", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$size": 0}}}, {"$project": {"c_name": 1}}], "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey + 1490)")
query("lookup_clashing_names", "SELECT n_nationkey, n_name AS __key, n_regionkey AS __doc, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey", lambda t: _clashing(t).aggregate([{"$lookup": {"from": "region", "localField": "__doc", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}, {"$addFields": {"r": "$r.r_name"}}]).df)
pipeline("lookup_semi", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$ne": []}}}, {"$project": {"c_name": 1}}], "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
pipeline("lookup_missing_collection", "region", [{"$lookup": {"from": "nowhere", "localField": "r_regionkey", "foreignField": "x", "as": "y"}}, {"$project": {"n": {"$size": "$y"}}}], "SELECT r_regionkey, 0::BIGINT AS n FROM region")
pipeline("lookup_array_keys", "nation", [{"$addFields": {"keys": ["$n_regionkey", {"$add": ["$n_regionkey", 1]}]}}, {"$lookup": {"from": "region", "localField": "keys", "foreignField": "r_regionkey", "as": "r"}}, {"$project": {"names": {"$map": {"input": "$r", "in": "$$this.r_name"}}}}], "SELECT n_nationkey, list_sort(array_agg(r_name ORDER BY r_regionkey)) AS names FROM nation JOIN region ON r_regionkey IN (n_regionkey, n_regionkey + 1) GROUP BY 1")


def _clashing(t: Tables) -> Collection:
    return Collection(t["nation"].df().select("n_nationkey", F.col("n_name").alias("__key"), F.col("n_regionkey").alias("__doc")), "n_nationkey", plain=True, database=t)


# -- updates, as the documents that they leave


def updated(name: str, table: str, where: dict, change: dict | list, sql: str, columns: list[str] | None = None, filters: list[dict] | None = None, first: list[dict] | None = None, shown: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def make(t: Tables) -> DataFrame:
        from .operators.filters import compile_filter

        frame = _then(t, table, first) if first else t[table].frame()
        done, _ = update_rows(frame, compile_filter(where, frame.env()), change, where, filters)
        return shown(done.df) if shown else done.df.select(*(columns or [c for c in done.df.columns if c != "__changed"]))

    query(name, sql, make)


updated("update_set_inc_mul", "customer", {"c_mktsegment": "BUILDING"}, {"$set": {"c_mktsegment": "HOUSE"}, "$inc": {"c_acctbal": 10.5}, "$mul": {"c_nationkey": 2}}, "SELECT c_custkey, c_name, CASE WHEN b THEN c_nationkey * 2 ELSE c_nationkey END AS c_nationkey, CASE WHEN b THEN c_acctbal + 10.5 ELSE c_acctbal END AS c_acctbal, CASE WHEN b THEN 'HOUSE' ELSE c_mktsegment END AS c_mktsegment FROM (SELECT *, c_mktsegment = 'BUILDING' AS b FROM customer)")
updated("update_min_max_bit", "part", {"p_size": {"$gt": 10}}, {"$min": {"p_retailprice": 1000.0}, "$max": {"p_size": 30}, "$rename": {"p_brand": "brand"}}, "SELECT p_partkey, CASE WHEN b THEN least(p_retailprice, 1000.0) ELSE p_retailprice END AS p_retailprice, CASE WHEN b THEN greatest(p_size, 30) ELSE p_size END::BIGINT AS p_size, CASE WHEN NOT b THEN p_brand END AS p_brand, CASE WHEN b THEN p_brand END AS brand FROM (SELECT *, p_size > 10 AS b FROM part)", ["p_partkey", "p_retailprice", "p_size", "p_brand", "brand"])
WORDS = [{"$project": {"w": {"$split": ["$p_type", " "]}, "p_size": 1}}]
updated("update_push_sort_slice", "part", {"p_size": {"$lt": 25}}, {"$push": {"w": {"$each": ["NEW", "AAA"], "$sort": 1, "$slice": 3}}}, "SELECT p_partkey, p_size, CASE WHEN p_size < 25 THEN list_sort(list_concat(string_split(p_type, ' '), ['NEW', 'AAA']))[1:3] ELSE string_split(p_type, ' ') END AS w FROM part", first=WORDS)
NAMES = [{"$project": {"w": {"$split": ["$p_name", " "]}, "p_size": 1}}]
SPLIT = "SELECT p_partkey, p_size, string_split(p_name, ' ') AS w FROM part"
updated("update_pull_add", "part", {"w": "small"}, {"$pull": {"w": "small"}}, f"SELECT p_partkey, list_filter(w, lambda x: x <> 'small') AS w FROM ({SPLIT})", ["p_partkey", "w"], first=NAMES)
updated("update_add_to_set", "part", {"p_size": {"$gt": 20}}, {"$addToSet": {"w": {"$each": ["bolt", "zinc", "zinc"]}}}, f"SELECT p_partkey, CASE WHEN p_size > 20 THEN list_concat(list_concat(w, CASE WHEN list_contains(w, 'bolt') THEN [] ELSE ['bolt'] END), ['zinc']) ELSE w END AS w FROM ({SPLIT})", ["p_partkey", "w"], first=NAMES)
updated("update_pull_all", "part", {}, {"$pullAll": {"w": ["small", "bolt", "none"]}}, f"SELECT p_partkey, list_filter(w, lambda x: x NOT IN ('small', 'bolt')) AS w FROM ({SPLIT})", ["p_partkey", "w"], first=NAMES)
updated("update_pop_last", "part", {"p_size": {"$lt": 30}}, {"$pop": {"w": 1}}, f"SELECT p_partkey, CASE WHEN p_size < 30 THEN w[:len(w) - 1] ELSE w END AS w FROM ({SPLIT})", ["p_partkey", "w"], first=NAMES)
updated("update_pop_first", "part", {"p_size": {"$lt": 30}}, {"$pop": {"w": -1}}, f"SELECT p_partkey, CASE WHEN p_size < 30 THEN w[2:] ELSE w END AS w FROM ({SPLIT})", ["p_partkey", "w"], first=NAMES)
updated("update_all_elements", "part", {"p_size": {"$gt": 25}}, {"$set": {"w.$[]": "same"}}, f"SELECT p_partkey, CASE WHEN p_size > 25 THEN list_transform(w, lambda x: 'same') ELSE w END AS w FROM ({SPLIT})", ["p_partkey", "w"], first=NAMES)
updated("update_unset", "part", {"p_size": {"$gt": 10}}, {"$unset": {"p_brand": ""}}, "SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_brand END AS p_brand FROM part", ["p_partkey", "p_brand"])
updated("update_current_date", "region", {}, {"$currentDate": {"at": True, "stamp": {"$type": "date"}}}, "SELECT r_regionkey, true AS fresh FROM region", shown=lambda df: df.select("r_regionkey", ((F.col("at") == F.col("stamp")) & (F.abs(F.unix_seconds("at") - F.unix_timestamp()) < 3600)).alias("fresh")))
updated("update_positional", "part", {"w": {"$regex": "^S"}}, {"$set": {"w.$": "HIT"}}, "SELECT p_partkey, CASE WHEN len(list_filter(w, lambda x: starts_with(x, 'S'))) > 0 THEN list_transform(w, lambda x, i: CASE WHEN i = list_position(list_transform(w, lambda y: starts_with(y, 'S')), true) THEN 'HIT' ELSE x END) ELSE w END AS w FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)", ["p_partkey", "w"], first=WORDS)
updated("update_array_filters", "part", {}, {"$set": {"w.$[e]": "METAL"}}, f"SELECT p_partkey, list_transform(w, lambda x: CASE WHEN x IN ('bolt', 'gear') THEN 'METAL' ELSE x END) AS w FROM ({SPLIT})", ["p_partkey", "w"], [{"e": {"$in": ["bolt", "gear"]}}], NAMES)
updated("update_bit", "part", {"p_size": {"$gt": 10}}, {"$bit": {"p_size": {"xor": 6}}}, "SELECT p_partkey, CASE WHEN p_size > 10 THEN xor(p_size, 6) ELSE p_size END AS p_size FROM part", ["p_partkey", "p_size"])
updated("update_pipeline", "orders", {"o_orderstatus": "F"}, [{"$set": {"o_totalprice": {"$round": [{"$multiply": ["$o_totalprice", 0.9]}, 2]}, "o_orderkey": 0}}], "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN round_even(o_totalprice * 0.9 * 100, 0) / 100 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
query("update_all", "SELECT r_regionkey, r_name, 'x' AS tag FROM region", lambda t: apply_update(t["region"].frame(), {"$set": {"tag": "x"}, "$setOnInsert": {"no": 1}}).df)
query("delete_many", "SELECT * FROM customer WHERE NOT c_acctbal < 0", lambda t: _deleted(t, {"c_acctbal": {"$lt": 0}}))


def _deleted(t: Tables, where: dict) -> DataFrame:
    from .operators.filters import compile_filter, negate

    frame = t["customer"].frame()
    return frame.df.where(negate(compile_filter(where, frame.env())))


# -- expiry

query(
    "ttl_sweep", "SELECT event_id FROM events WHERE NOT ts < (SELECT min(ts) FROM events) + INTERVAL 10 DAY - INTERVAL 1 HOUR",
    lambda t: indexes.sweep(t["events"].frame(), [indexes.make({"ts": 1}, "event_id", expire_after=3600)], t["events"].df().agg(F.min("ts")).first()[0] + dt.timedelta(days=10)).select("event_id"),
)

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["group_revenue_by_flag"](spark, sf_dir)


from . import write_queries  # noqa: E402, F401  registers the queries of writes, cursors, indexes and commands
