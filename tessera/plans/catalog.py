"""Queries by name, over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.convert import convert, from_ordered_bytes, list_remove, map_put, ordered_bytes, set_of, upgraded
from tessera.functions.lineage import shared_path
from tessera.functions.ordering import sort_key
from tessera.operators import changes as ch
from tessera.operators import consistency, constraints, evolve, graph, kv, navigate, paths, sets
from tessera.operators.bounds import Bounds, Values
from tessera.operators.index import IndexView, composite_index, list_index, map_value_index, simple_index
from tessera.operators.model import Field, Model, ObjType, Snapshot, ref
from tessera.plans.tables import MODEL, objects, orders_with_parts, table
from tessera.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# Extents and lookups


@query("SELECT c_custkey AS _id FROM customer")
def extent_customer(spark, d):
    return objects(spark, d).extent("Customer").select("_id")


@query("SELECT 'Customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'Supplier', s_suppkey FROM supplier")
def extent_polymorphic_party(spark, d):
    return objects(spark, d).extent("Party").select(F.col("_type").alias("kind"), F.col("_id").alias("id"))


@query("SELECT 'Customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Supplier', count(*) FROM supplier")
def extent_all(spark, d):
    return objects(spark, d).extent().groupBy(F.col("_type").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT CAST(1 AS INTEGER) AS version, 'Customer' AS kind, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 2, 'Customer', count(*) FROM customer WHERE c_custkey % 2 <> 0")
def extent_schema_groups(spark, d):
    s = objects(spark, d, "Customer")
    s = s.replaced(Customer=s.of("Customer").withColumn("_version", F.when(F.col("_id") % 2 == 0, 1).otherwise(2)))
    return s.by_version().select(F.col("_version").alias("version"), F.col("_type").alias("kind"), F.col("objects").alias("n"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def point_lookup_batch(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("_id")).distinct()
    return objects(spark, d, "Order").get("Order", ids).select(F.col("_id").alias("id"), F.col("o_totalprice").alias("price"))


@query("SELECT user_id AS id, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS there FROM (SELECT DISTINCT user_id FROM events)")
def exists_batch(spark, d):
    s = objects(spark, d, "Customer")
    s = s.replaced(Customer=s.of("Customer").where("c_acctbal >= 0"))
    return s.exists("Customer", table(spark, d, "events").select(F.col("user_id").alias("_id"))).select(F.col("_id").alias("id"), F.col("found").alias("there"))


@query("SELECT r_regionkey AS id, r_name AS name FROM region ORDER BY r_regionkey LIMIT 1")
def singleton_get(spark, d):
    return objects(spark, d, "Region").singleton("Region").select(F.col("_id").alias("id"), F.col("r_name").alias("name"))


@query("SELECT c_custkey AS id, coalesce(nullif(c_mktsegment, 'BUILDING'), 'NONE') AS segment FROM customer")
def read_with_default(spark, d):
    s = objects(spark, d, "Customer")
    kind = ObjType("Customer", (Field("segment", column="seg", default="NONE"),))
    s = Snapshot(Model([kind]), {"Customer": s.of("Customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))})
    return s.read("Customer", "segment").select(F.col("_id").alias("id"), "segment")


# Index views


@query("SELECT c_custkey AS _id FROM customer WHERE c_mktsegment = 'BUILDING'")
def index1_lookup(spark, d):
    return simple_index(objects(spark, d), "Customer", "segment").get("BUILDING")


@query("SELECT c_custkey AS _id FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL")
def index1_lookup_null(spark, d):
    s = objects(spark, d)
    s = s.replaced(Customer=s.of("Customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))))
    return simple_index(s, "Customer", "segment").get(None)


@query("SELECT c_mktsegment AS value, count(*) AS n, min(c_custkey) AS \"first\", max(c_custkey) AS \"last\" FROM customer GROUP BY 1")
def index1_asmap(spark, d):
    return simple_index(objects(spark, d), "Customer", "segment").summary()


@query("SELECT balance, id FROM (SELECT c_acctbal AS balance, c_custkey AS id FROM customer UNION SELECT s_acctbal, s_suppkey FROM supplier) WHERE balance >= 0 AND balance < 1000")
def index1_bounds(spark, d):
    return simple_index(objects(spark, d), "Party", "balance").within(Bounds(0.0, 1000.0)).as_set().select(F.col("value").alias("balance"), F.col("_id").alias("id"))


@query("SELECT nullif(c_mktsegment, 'BUILDING') AS segment, c_custkey AS id FROM customer WHERE nullif(c_mktsegment, 'BUILDING') >= 'HOUSEHOLD' OR nullif(c_mktsegment, 'BUILDING') IS NULL")
def index1_bounds_open_null(spark, d):
    s = objects(spark, d)
    s = s.replaced(Customer=s.of("Customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))))
    return simple_index(s, "Customer", "segment").within(Bounds.ge("HOUSEHOLD")).as_set().select(F.col("value").alias("segment"), F.col("_id").alias("id"))


@query("SELECT event_type AS type, event_id AS id FROM events WHERE event_id >= 100 AND event_id < 500")
def index1_target_bounds(spark, d):
    return simple_index(objects(spark, d), "Event", "type").within_target(Bounds(100, 500)).as_set().select(F.col("value").alias("type"), F.col("_id").alias("id"))


@query("SELECT DISTINCT p_brand AS brand, p_size AS size, p_partkey AS id FROM part")
def index2_asset(spark, d):
    return composite_index(objects(spark, d), "Part", "brandSize").as_set().withColumnRenamed("_id", "id")


@query("SELECT p_brand AS brand, p_size AS size, count(*) AS n, min(p_partkey) AS \"first\", max(p_partkey) AS \"last\" FROM part GROUP BY 1, 2")
def index2_asmap(spark, d):
    return composite_index(objects(spark, d), "Part", "brandSize").summary()


@query("SELECT p_brand AS brand, count(*) AS entries FROM part GROUP BY 1")
def index2_asmap_of_index1(spark, d):
    return composite_index(objects(spark, d), "Part", "brandSize").as_map_of_index(1)


@query("SELECT DISTINCT p_brand AS brand, p_size AS size FROM part")
def index2_prefix(spark, d):
    return composite_index(objects(spark, d), "Part", "brandSize").as_index(1).as_set()


@query("SELECT p_brand AS brand, p_size AS size, p_partkey AS id FROM part WHERE p_brand >= 'Brand#2' AND p_brand < 'Brand#4' AND p_size > 10")
def index2_bounds(spark, d):
    v = composite_index(objects(spark, d), "Part", "brandSize").within(Bounds("Brand#2", "Brand#4"), 1).within(Bounds.gt(10), 2)
    return v.as_set().withColumnRenamed("_id", "id")


@query("SELECT p_brand AS brand, p_type AS type, count(DISTINCT p_size) AS sizes, min(p_size) AS least FROM part GROUP BY 1, 2")
def index3_views(spark, d):
    v = composite_index(objects(spark, d), "Part", "brandTypeSize").as_index(2)
    return v.entries.groupBy(*v.values).agg(F.count(v.target).alias("sizes"), F.min(v.target).alias("least"))


@query("SELECT DISTINCT p_brand AS brand, p_type AS type FROM part WHERE p_size <= 25")
def index3_prefix(spark, d):
    return composite_index(objects(spark, d), "Part", "brandTypeSize").within(Bounds.le(25), 3).as_index(2).as_index(1).as_set()


@query("SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line, count(*) AS entries FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_shipdate, l_orderkey FROM lineitem) GROUP BY 1, 2, 3")
def index4_views(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("shipped"), F.col("l_orderkey").alias("_id"))
    return IndexView(rows, ["flag", "status", "line", "shipped"]).as_map_of_index(3)


@query("SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'")
def index4_prefix(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("shipped"), F.col("l_orderkey").alias("_id"))
    v = IndexView(rows, ["flag", "status", "line", "shipped"]).matching(F.col("shipped") >= F.lit("1997-01-01 00:00:00").cast("timestamp"))
    return v.as_index(3).as_index(2).as_set()


@query("SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS place, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, unnest(generate_series(1, len(embedding))) AS t(i)")
def list_element_index(spark, d):
    e = table(spark, d, "embeddings").withColumn("_id", F.col("vec_id"))
    s = Snapshot(Model([ObjType("Vector", (Field("embedding", "list", indexed=frozenset({"element"})),))]), {"Vector": e})
    return list_index(s, "Vector", "embedding").entries.select(F.col("_id").alias("id"), F.col("index").alias("place"), F.col("value").cast("double").alias("value"))


@query("SELECT s AS status, l_orderkey AS id, l_returnflag AS flag FROM (SELECT l_orderkey, l_returnflag, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2) WHERE s = 'F'")
def map_value_index_lookup(spark, d):
    v = map_value_index(orders_with_parts(spark, d), "Order", "flags").within(Bounds.eq("F"))
    return v.as_set().select(F.col("value").alias("status"), F.col("_id").alias("id"), F.col("key").alias("flag"))


@query("SELECT l_returnflag AS value, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS \"first\", max(l_orderkey) AS \"last\" FROM lineitem GROUP BY 1")
def map_key_index(spark, d):
    return simple_index(orders_with_parts(spark, d), "Order", "flags.key").summary()


@query("SELECT DISTINCT l_partkey AS part, l_orderkey AS id FROM lineitem")
def list_element_index_dedup(spark, d):
    return simple_index(orders_with_parts(spark, d), "Order", "parts.element").as_set(ordered=False).select(F.col("value").alias("part"), F.col("_id").alias("id"))


@query("SELECT DISTINCT l_suppkey AS value, l_orderkey AS id FROM lineitem")
def set_element_index(spark, d):
    held = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(F.collect_set("l_suppkey").alias("suppliers"))
    s = Snapshot(Model([ObjType("Order", (Field("suppliers", "set", indexed=frozenset({"element"})),))]), {"Order": held})
    return simple_index(s, "Order", "suppliers.element").as_set(ordered=False).select("value", F.col("_id").alias("id"))


# Predicates


@query("SELECT p_partkey AS id, p_size AS size FROM part WHERE nullif(p_size, 7) IS NULL OR p_size IN (1, 3) OR (p_size >= 10 AND p_size < 20)")
def values_matcher(spark, d):
    rows = table(spark, d, "part").withColumn("s", F.nullif("p_size", F.lit(7)))
    m = Values(nulls=True, literals=(1, 3), ranges=(Bounds(10, 20),))
    return rows.where(m.predicate(F.col("s"))).select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))


@query("SELECT p_partkey AS id FROM part WHERE p_size >= 5 AND p_size < 30")
def bounds_union(spark, d):
    return table(spark, d, "part").where(Bounds(5, 20).union(Bounds(15, 30)).predicate(F.col("p_size"))).select(F.col("p_partkey").alias("id"))


@query("SELECT c_custkey AS id FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL OR nullif(c_mktsegment, 'BUILDING') > 'FURNITURE'")
def bounds_null_is_greatest(spark, d):
    return table(spark, d, "customer").where(Bounds.gt("FURNITURE").predicate(F.nullif("c_mktsegment", F.lit("BUILDING")))).select(F.col("c_custkey").alias("id"))


@query(
    "WITH r AS (SELECT l_suppkey AS g, date_diff('day', TIMESTAMP '1990-01-01', l_shipdate) AS lo FROM lineitem), "
    "m AS (SELECT g, lo, CASE WHEN lo > max(lo + 3) OVER (PARTITION BY g ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS isnew FROM r), "
    "i AS (SELECT g, lo, sum(isnew) OVER (PARTITION BY g ORDER BY lo ROWS UNBOUNDED PRECEDING) AS island FROM m) "
    "SELECT g AS supplier, CAST(min(lo) AS INTEGER) AS \"min\", CAST(max(lo + 3) AS INTEGER) AS \"max\" FROM i GROUP BY g, island"
)
def key_ranges_coalesce(spark, d):
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), day.alias("min"), (day + 3).alias("max"))
    return kv.coalesced(r, ["supplier"])


# Keys and values


def _orders_kv(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"))


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey >= 100 ORDER BY 1 LIMIT 1")
def kv_at_least(spark, d):
    return kv.at_least(_orders_kv(spark, d), 100)


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey < 1000 ORDER BY 1 DESC LIMIT 1")
def kv_at_most(spark, d):
    return kv.at_most(_orders_kv(spark, d), 1000)


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey >= 200 AND o_orderkey < 900")
def kv_range_reverse(spark, d):
    return kv.scan(_orders_kv(spark, d), kv.KeyRange(200, 900), reverse=True)


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE (o_orderkey >= 10 AND o_orderkey < 60) OR o_orderkey >= 1200")
def kv_ranges_filter(spark, d):
    return kv.scan(_orders_kv(spark, d), kv.KeyRanges([kv.KeyRange(10, 40), kv.KeyRange(30, 60), kv.KeyRange(1200, None)]))


@query("SELECT o_orderkey AS key, o_orderkey AS back FROM orders")
def kv_key_codec(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), ordered_bytes(F.col("o_orderkey")).alias("raw"))
    return keys.select("key", from_ordered_bytes(F.col("raw")).alias("back"))


@query("SELECT user_id AS key, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1")
def counter_fold(spark, d):
    return kv.fold_counters(table(spark, d, "events").select(F.col("user_id").alias("key"), F.round("value").cast("long").alias("delta")))


@query("SELECT c_custkey AS id, c_custkey + coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) AS counter FROM customer")
def counter_adjust(spark, d):
    s = objects(spark, d, "Customer")
    kind = ObjType("Customer", (Field("visits", "counter"),))
    s = Snapshot(Model([kind]), {"Customer": s.of("Customer").select("_id", F.col("_id").alias("visits"))})
    return s.adjusted("Customer", "visits", table(spark, d, "orders").select(F.col("o_custkey").alias("_id"), F.lit(1).alias("delta"))).of("Customer").select(F.col("_id").alias("id"), F.col("visits").alias("counter"))


# Set algebra


def _cust(spark, d, where):
    return table(spark, d, "orders").where(where).select(F.col("o_custkey").alias("id"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_union(spark, d):
    return sets.union(_cust(spark, d, "o_orderstatus = 'F'"), _cust(spark, d, "o_totalprice > 200000"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_intersection(spark, d):
    return sets.intersection(_cust(spark, d, "o_orderstatus = 'F'"), _cust(spark, d, "o_totalprice > 200000"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersection_nary(spark, d):
    return sets.intersection(*[_cust(spark, d, f"o_orderstatus = '{x}'") for x in "FOP"])


@query("SELECT o_custkey AS id FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, d):
    return sets.difference(_cust(spark, d, "o_totalprice > 100000"), _cust(spark, d, "o_orderstatus = 'P'"))


@query("(SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_symdiff(spark, d):
    return sets.symmetric_difference(_cust(spark, d, "o_orderstatus = 'F'"), _cust(spark, d, "o_orderstatus = 'P'"))


# Navigation


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("(SELECT 'first' AS place, o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_orderkey LIMIT 1) UNION ALL (SELECT 'last', o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1)")
def nav_first_last(spark, d):
    o = _orders(spark, d)
    return navigate.first(o, "id").select(F.lit("first").alias("place"), "*").unionByName(navigate.last(o, "id").select(F.lit("last").alias("place"), "*"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice <= 150000 ORDER BY o_totalprice DESC LIMIT 1")
def nav_floor(spark, d):
    return navigate.floor(_orders(spark, d), "price", 150000.0)


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice >= 150000 ORDER BY o_totalprice LIMIT 1")
def nav_ceiling(spark, d):
    return navigate.ceiling(_orders(spark, d), "price", 150000.0)


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey < 77 ORDER BY 1 DESC LIMIT 1")
def nav_lower(spark, d):
    return navigate.lower(_orders(spark, d), "id", 77)


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey > 77 ORDER BY 1 LIMIT 1")
def nav_higher(spark, d):
    return navigate.higher(_orders(spark, d), "id", 77)


@query("SELECT e.event_id AS event, max(o.day) AS floor_day FROM (SELECT event_id, date_diff('day', TIMESTAMP '1990-01-01', ts) AS day FROM events) e LEFT JOIN (SELECT DISTINCT date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS day FROM orders) o ON o.day <= e.day GROUP BY 1")
def nav_asof_floor(spark, d):
    day = lambda c: F.date_diff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("day")
    e = table(spark, d, "events").select(F.col("event_id").alias("event"), day("ts"))
    o = table(spark, d, "orders").select(day("o_orderdate")).distinct()
    return navigate.floors(e, o, "day", carry=["day"]).select("event", "floor_day")


@query("SELECT a.event_id AS event, max(b.value) AS floor_value FROM events a LEFT JOIN events b ON a.event_type = b.event_type AND b.value < a.value GROUP BY 1")
def nav_asof_lower_by_type(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("event"), "event_type", "value")
    return navigate.floors(e, e.select("event_type", "value"), "value", ["event_type"], carry=["value"], inclusive=False).select("event", "floor_value")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 120000")
def nav_subset_desc(spark, d):
    return navigate.sub_set(_orders(spark, d), "price", Bounds(100000.0, 120000.0, False, True), True)


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 100)) ORDER BY 1 LIMIT 100")
def pager_page_2(spark, d):
    return navigate.Pager(_orders(spark, d), "id").next().page()


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice > 50000 ORDER BY o_orderkey DESC LIMIT 25")
def pager_descending_filtered(spark, d):
    return navigate.Pager(_orders(spark, d), "id", 25, True).filtered(F.col("price") > 50000).page()


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders)")
def nav_poll_first(spark, d):
    return navigate.poll_first(_orders(spark, d), "id")[1]


# Reference paths


def _path(spark, d, start, text, ids):
    s = objects(spark, d)
    return paths.follow(s, paths.parse(MODEL, start, text), ids(s).select("_id")).select(F.col("_type").alias("kind"), F.col("_id").alias("id"))


@query("SELECT DISTINCT 'Customer' AS kind, o_custkey AS id FROM orders WHERE o_totalprice > 250000")
def path_forward(spark, d):
    return _path(spark, d, "Order", "->customer", lambda s: s.of("Order").where("o_totalprice > 250000"))


@query("SELECT 'Order' AS kind, o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def path_inverse(spark, d):
    return _path(spark, d, "Customer", "<-Order.customer", lambda s: s.of("Customer").where("c_mktsegment = 'BUILDING'"))


@query("SELECT 'Order' AS kind, o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_region_orders(spark, d):
    return _path(spark, d, "Region", "<-Nation.region<-Customer.nation<-Order.customer", lambda s: s.of("Region"))


@query("SELECT DISTINCT 'Region' AS kind, n_regionkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def path_invert(spark, d):
    s = objects(spark, d)
    p = paths.parse(MODEL, "Region", "<-Nation.region<-Customer.nation<-Order.customer")
    return paths.follow_back(s, p, s.of("Order").where("o_orderstatus = 'P'").select("_id")).select(F.col("_type").alias("kind"), F.col("_id").alias("id"))


@query("SELECT DISTINCT 'Event' AS kind, e.event_id AS id FROM orders o JOIN events e ON e.user_id = o.o_custkey WHERE o.o_totalprice > 300000")
def path_forward_inverse(spark, d):
    return _path(spark, d, "Order", "->customer<-Event.user", lambda s: s.of("Order").where("o_totalprice > 300000"))


@query("SELECT DISTINCT 'Part' AS kind, l_partkey AS id FROM lineitem")
def path_complex_step(spark, d):
    s = orders_with_parts(spark, d)
    p = paths.parse(s.model, "Order", "->parts.element")
    return paths.follow(s, p, s.of("Order").select("_id")).select(F.col("_type").alias("kind"), F.col("_id").alias("id"))


@query("SELECT DISTINCT 'Order' AS kind, l_orderkey AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def path_complex_inverse(spark, d):
    s = orders_with_parts(spark, d)
    p = paths.parse(s.model, "Part", "<-Order.parts.element")
    return paths.follow(s, p, s.of("Part").where("p_size = 1").select("_id")).select(F.col("_type").alias("kind"), F.col("_id").alias("id"))


@query("SELECT DISTINCT 'Nation' AS kind, s_nationkey AS id FROM supplier")
def path_type_pruned(spark, d):
    s = objects(spark, d)
    return paths.follow(s, paths.parse(MODEL, "Party", "->Supplier.nation"), s.extent("Party")).select(F.col("_type").alias("kind"), F.col("_id").alias("id"))


@query("SELECT 'Customer' AS kind, c_custkey AS id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'Supplier', s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def path_inverse_polymorphic(spark, d):
    return _path(spark, d, "Region", "<-Nation.region<-Party.nation", lambda s: s.of("Region").where("_id = 1"))


# Cascades, copies, deletion: customers as a tree, each with the one of half its key as parent


def _tree(spark, d):
    kind = ObjType("Node", (ref("parent", "Node", on_delete="DELETE", cascades=frozenset({"tree", "ancestors"}), inverse_cascades=frozenset({"tree", "descendants"})), Field("label")))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.nullif(F.floor(F.col("c_custkey") / 2), F.lit(0)).alias("parent"), F.col("c_name").alias("label"))
    return Snapshot(Model([kind]), {"Node": rows})


def _cascade(spark, d, name, start, most):
    s = _tree(spark, d)
    begin = s.of("Node").where(start).select(F.lit("Node").alias("_type"), "_id")
    return graph.cascade(graph.cascade_edges(s, name), graph.nodes(begin), most).select(F.col("node._id").alias("id"), "distance")


_DOWN = "WITH RECURSIVE t(id, distance) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey = 3 UNION SELECT c_custkey, distance + 1 FROM customer, t WHERE c_custkey // 2 = t.id AND distance < {n}) SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM t GROUP BY 1"


@query(_DOWN.format(n=1))
def cascade_bounded_1(spark, d):
    return _cascade(spark, d, "descendants", "_id = 3", 1)


@query(_DOWN.format(n=2))
def cascade_bounded_2(spark, d):
    return _cascade(spark, d, "descendants", "_id = 3", 2)


@query(_DOWN.format(n=3))
def cascade_bounded_3(spark, d):
    return _cascade(spark, d, "descendants", "_id = 3", 3)


@query("WITH RECURSIVE t(id, distance) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey = 37 UNION SELECT id // 2, distance + 1 FROM t WHERE id // 2 > 0) SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM t WHERE id IN (SELECT c_custkey FROM customer) GROUP BY 1")
def cascade_forward_unbounded(spark, d):
    return _cascade(spark, d, "ancestors", "_id = 37", -1)


@query("WITH RECURSIVE e(a, b) AS (SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey // 2 > 0), u(a, b) AS (SELECT a, b FROM e UNION SELECT b, a FROM e), t(id, distance) AS (SELECT CAST(5 AS BIGINT), 0 UNION SELECT u.b, distance + 1 FROM u, t WHERE u.a = t.id AND distance < 3) SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM t GROUP BY 1")
def cascade_forward_inverse(spark, d):
    return _cascade(spark, d, "tree", "_id = 5", 3)


@query("WITH RECURSIVE t(id) AS (SELECT c_custkey FROM customer WHERE c_custkey = 6 UNION SELECT c_custkey FROM customer, t WHERE c_custkey // 2 = t.id) SELECT c_custkey AS id, c_name AS label FROM customer WHERE c_custkey IN (SELECT id FROM t) OR c_custkey % 10 = 1")
def copy_closure(spark, d):
    s = _tree(spark, d)
    into = Snapshot(s.model, {"Node": s.of("Node").where("_id % 10 = 1")})
    begin = s.of("Node").where("_id = 6").select(F.lit("Node").alias("_type"), "_id")
    return graph.copy_closure(s, into, begin, ["descendants"]).of("Node").select(F.col("_id").alias("id"), "label")


@query("WITH RECURSIVE t(id) AS (SELECT c_custkey FROM customer WHERE c_custkey = 2 UNION SELECT c_custkey FROM customer, t WHERE c_custkey // 2 = t.id) SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM t)")
def delete_cascade(spark, d):
    s = _tree(spark, d)
    start = s.of("Node").where("_id = 2").select(F.lit("Node").alias("_type"), "_id")
    return graph.delete(s, start).checked().of("Node").select(F.col("_id").alias("id"))


def _without_nation(spark, d):
    s = objects(spark, d, "Region", "Nation", "Supplier")
    return graph.delete(s, s.of("Nation").where("_id < 10").select(F.lit("Nation").alias("_type"), "_id"))


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey < 10 THEN NULL ELSE s_nationkey END AS nation FROM supplier")
def delete_nullify(spark, d):
    return _without_nation(spark, d).after.of("Supplier").select(F.col("_id").alias("id"), F.col("s_nationkey").alias("nation"))


@query("SELECT l_orderkey AS id, count(*) AS parts, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10) GROUP BY 1 UNION ALL SELECT l_orderkey, 0, NULL FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10) THEN 0 ELSE 1 END) = 0")
def delete_remove(spark, d):
    s = orders_with_parts(spark, d)
    gone = graph.delete(s, s.of("Part").where("p_size <= 10").select(F.lit("Part").alias("_type"), "_id"))
    left = gone.after.of("Order").select("_id", F.size("parts").cast("long").alias("parts"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum"))
    return left.select(F.col("_id").alias("id"), "parts", F.when(F.col("parts") > 0, F.col("sum")).alias("total"))


@query("SELECT 'Order' AS kind, o_orderkey AS id, o_custkey AS customer FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def delete_exception_check(spark, d):
    s = objects(spark, d, "Region", "Nation", "Customer", "Order")
    found = graph.delete(s, s.of("Customer").where("c_mktsegment = 'MACHINERY'").select(F.lit("Customer").alias("_type"), "_id"))
    return found.blockers.select(F.col("_type").alias("kind"), F.col("_id").alias("id"), F.col("to_id").alias("customer"))


@query("SELECT 'Event' AS kind, event_id AS id, user_id AS missing FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def dangling_refs(spark, d):
    s = objects(spark, d, "Region", "Nation", "Customer", "Event")
    s = s.replaced(Customer=s.of("Customer").where("_id % 3 <> 0"))
    return graph.dangling(s).select(F.col("_type").alias("kind"), F.col("_id").alias("id"), F.col("to_id").alias("missing"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def dependent_gc(spark, d):
    s = objects(spark, d, "Region", "Nation", "Customer", "Order")
    s = s.replaced(Order=s.of("Order").where("o_totalprice > 200000"))
    return graph.unreferenced(s, "Customer").select(F.col("_id").alias("id"))


@query("SELECT c_custkey + 1000000 AS id, coalesce(nullif(c_custkey // 2, 0) + 1000000, NULL) AS parent FROM customer")
def copy_with_new_ids(spark, d):
    s = _tree(spark, d)
    ids = s.of("Node").select(F.col("_id").alias("old"), (F.col("_id") + 1000000).alias("new"))
    return graph.with_new_ids(s.of("Node"), ["parent"], ids).select(F.col("_id").alias("id"), "parent")


# Constraints


@query("SELECT c_mktsegment AS value, count(*) AS n, min(c_custkey) AS \"first\" FROM customer GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, d):
    found = constraints.unique_field(objects(spark, d), "Customer", "segment")
    return found.select("value", "n", F.array_min("objects").alias("first"))


@query("SELECT nullif(c_mktsegment, 'BUILDING') AS value, count(*) AS n, least(count(*), 5) AS named FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1 HAVING count(*) > 1")
def unique_with_excludes(spark, d):
    s = objects(spark, d)
    s = s.replaced(Customer=s.of("Customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))))
    found = constraints.unique_field(s, "Customer", "segment", Values(literals=("MACHINERY",)))
    return found.select("value", "n", F.size("objects").cast("long").alias("named"))


@query("SELECT p_brand AS brand, p_size AS size, count(*) AS n FROM part WHERE NOT (p_brand = 'Brand#11' AND p_size BETWEEN 1 AND 9) GROUP BY 1, 2 HAVING count(*) > 1")
def composite_unique(spark, d):
    return constraints.unique_composite(objects(spark, d), "Part", "brandSize", [("Brand#11", Values(ranges=(Bounds(1, 10),)))]).drop("objects")


@query("SELECT 'Region' AS kind, count(*) AS n FROM region HAVING count(*) > 1")
def singleton_check(spark, d):
    s = Snapshot(Model([ObjType("Region", (), singleton=True)]), {"Region": objects(spark, d, "Region").of("Region")})
    return constraints.singleton_violations(s).select(F.col("_type").alias("kind"), "n")


@query("SELECT CAST(1 AS INTEGER) AS phase, 'Customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, 'balance' AS \"rule\" FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 1, 'Supplier', CAST(s_suppkey AS VARCHAR), 'balance' FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 4, 'Customer', CAST(c_custkey AS VARCHAR), 'segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')")
def validate_predicates(spark, d):
    s = objects(spark, d)
    balance = lambda rows: rows.where(F.coalesce(*[F.col(c) for c in rows.columns if c.endswith("acctbal")]) < 0)
    rules = [constraints.Rule("Party", "balance", balance, early=True), constraints.Rule("Customer", "segment", F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY")), constraints.Rule("Customer", "strict", F.lit(False), frozenset({"strict"}))]
    found = constraints.validate(s, rules)
    return found.select("phase", F.col("_type").alias("kind"), F.col("_id").alias("id"), "rule")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def validate_touched(spark, d):
    s = objects(spark, d, "Region", "Nation", "Customer")
    touched = {"Customer": table(spark, d, "orders").select(F.col("o_custkey").alias("_id")).distinct()}
    return constraints.validate(s, [constraints.Rule("Customer", "balance", F.col("c_acctbal") >= 0)], touched=touched).where("phase = 4").select(F.col("_id").alias("id"))


# Schema evolution

_V1 = ObjType("Part", (Field("brand", column="p_brand"), Field("size", column="p_size"), Field("gone", column="p_name")))


def _evolved(spark, d, policy, source):
    new = ObjType("Part", (Field("brand", column="p_brand", default=-1), Field("size", column="p_size"), Field("stock", default=0)), version=2)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("_id"), source.alias("p_brand"), "p_size", "p_name")
    out = evolve.migrate(rows, _V1, new, {"brand": policy}, kinds={"brand": "int", "stock": "int"})
    return out.select(F.col("_id").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "stock", F.col("_version").alias("version"))


@query("SELECT p_partkey AS id, CAST(-1 AS INTEGER) AS brand, p_size AS size, CAST(0 AS INTEGER) AS stock, CAST(2 AS INTEGER) AS version FROM part")
def evolve_reset(spark, d):
    return _evolved(spark, d, "RESET", F.substring("p_brand", 7, 2))


@query("SELECT p_partkey AS id, coalesce(try_cast(CASE WHEN p_size % 2 = 0 THEN 'x' ELSE substr(p_brand, 7, 2) END AS INTEGER), -1) AS brand, p_size AS size, CAST(0 AS INTEGER) AS stock, CAST(2 AS INTEGER) AS version FROM part")
def evolve_attempt(spark, d):
    return _evolved(spark, d, "ATTEMPT", F.when(F.col("p_size") % 2 == 0, "x").otherwise(F.substring("p_brand", 7, 2)))


@query("SELECT p_partkey AS id, CAST(substr(p_brand, 7, 2) AS INTEGER) AS brand, p_size AS size, CAST(0 AS INTEGER) AS stock, CAST(2 AS INTEGER) AS version FROM part")
def evolve_require(spark, d):
    return _evolved(spark, d, "REQUIRE", F.substring("p_brand", 7, 2))


@query("SELECT p_partkey AS id, p_brand AS brand, CAST(NULL AS INTEGER) AS stock FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, p_brand, 5 FROM part WHERE p_size >= 10")
def evolve_add_drop_field(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), "p_size")
    return evolve.all_versions(p.where("p_size < 10").drop("p_size"), p.where("p_size >= 10").drop("p_size").withColumn("stock", F.lit(5)))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS customer FROM orders")
def evolve_removed_type(spark, d):
    kinds = Model([ObjType("Even", ()), ObjType("Odd", ())])
    types = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.when(F.col("c_custkey") % 2 == 0, "Even").otherwise("Odd").alias("_type"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    return evolve.without_removed_types(rows, "customer", kinds, types, ("Even",))


# Values


@query("SELECT o_orderkey AS id, CAST((((o_orderkey * 37) & 255) + 128) % 256 - 128 AS INTEGER) AS low, o_orderkey <> 0 AS truth, CAST(o_orderkey AS VARCHAR) AS said FROM orders")
def convert_values(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), convert(k * 37, "bigint", "tinyint").cast("int").alias("low"), convert(k, "bigint", "boolean").alias("truth"), convert(k, "bigint", "string").alias("said"))


@query("SELECT p_partkey AS id, CAST(p_retailprice AS INTEGER) - CASE WHEN CAST(p_retailprice AS INTEGER) > p_retailprice THEN 1 ELSE 0 END AS whole FROM part")
def convert_fractions(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), convert(F.col("p_retailprice"), "double", "int").alias("whole"))


@query("SELECT l_orderkey AS id, count(*) - 1 AS after_remove, count(DISTINCT l_partkey) AS in_set, count(DISTINCT l_returnflag) + CASE WHEN max(CASE WHEN l_returnflag = 'X' THEN 1 ELSE 0 END) = 1 THEN 0 ELSE 1 END AS in_map FROM lineitem GROUP BY 1")
def collection_ops(spark, d):
    o = orders_with_parts(spark, d).of("Order")
    size = lambda c: F.size(c).cast("long")
    return o.select(F.col("_id").alias("id"), size(list_remove(F.col("parts"), 0)).alias("after_remove"), size(set_of(F.col("parts"))).alias("in_set"), size(map_put(F.col("flags"), F.lit("X"), F.lit("F"))).alias("in_map"))


@query("SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY substr(c_name, 10), c_custkey) AS INTEGER) AS place FROM customer")
def strict_order_utf16(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.substring("c_name", 10, 100).alias("name"))
    return navigate.numbered(c, sort_key(F.col("name"), "utf16"), F.col("id")).select("id", F.col("place").cast("int").alias("place"))


@query("SELECT o_orderkey AS id, CASE WHEN try_cast(o_orderpriority[1:1] AS INTEGER) IS NULL THEN -1 ELSE try_cast(o_orderpriority[1:1] AS INTEGER) END AS priority FROM orders")
def upgrade_values(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), upgraded(F.substring("o_orderpriority", 1, 1), "string", "int", "ATTEMPT", -1).alias("priority"))


# Changes


def _later(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), "c_mktsegment", "c_nationkey")
    new = c.where("_id % 7 <> 0").withColumn("c_mktsegment", F.when(F.col("_id") % 5 == 0, "NEW").otherwise(F.col("c_mktsegment")))
    return c.where("_id % 11 <> 0"), new


@query(
    "SELECT 'change' AS op, c_custkey AS id, 'c_mktsegment' AS field, c_mktsegment AS old, 'NEW' AS \"new\" FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 5 = 0 AND c_mktsegment <> 'NEW' "
    "UNION ALL SELECT 'create', c_custkey, NULL, NULL, NULL FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0 UNION ALL SELECT 'delete', c_custkey, NULL, NULL, NULL FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 = 0"
)
def change_diff(spark, d):
    old, new = _later(spark, d)
    return ch.diff(old, new, ["c_mktsegment", "c_nationkey"]).withColumnRenamed("_id", "id")


@query("SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def change_replay_lww(spark, d):
    return ch.last_writes(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).withColumnRenamed("user_id", "id")


@query("WITH e AS (SELECT user_id AS id, arg_max(event_type, event_id) AS v FROM events GROUP BY 1) SELECT c_custkey AS id, coalesce(e.v, c_mktsegment) AS state FROM customer LEFT JOIN e ON e.id = c_custkey WHERE e.v IS NULL OR e.v <> 'purchase'")
def change_replay(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_mktsegment").alias("state"))
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", ch.DELETE).otherwise(ch.CHANGE).alias("op"), F.col("user_id").alias("_id"), F.col("event_type").alias("value"))
    return ch.replay(base, e, "state").withColumnRenamed("_id", "id")


@query("SELECT DISTINCT 'byNation' AS listener, 'Order' AS kind, o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (3, 4) UNION ALL SELECT DISTINCT 'byNationEvents', 'Event', event_id FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey IN (3, 4)")
def notify_backtrack(spark, d):
    s = objects(spark, d)
    changed = s.of("Nation").where("_id IN (3, 4)").select("_id")
    found = ch.notices(s, {"byNation": paths.parse(MODEL, "Order", "->customer->nation"), "byNationEvents": paths.parse(MODEL, "Event", "->user->nation")}, changed)
    return found.select("listener", F.col("_type").alias("kind"), F.col("_id").alias("id"))


@query("SELECT event_type AS type, count(*) AS n, round(avg(value), 4) AS mean, round(CASE WHEN count(*) <= 1 THEN 0 ELSE var_pop(value) END, 3) AS variance FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def custom_index_stats(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("type"), "value", "event_id")
    some = lambda where: ch.moments(e.where(where), ["type"], F.col("value"))
    kept = ch.combined(ch.combined(some("event_id % 5 < 3"), some("event_id % 5 >= 3"), ["type"]), some("event_id % 5 = 0"), ["type"], -1)
    return ch.variance(kept, ["type"]).select("type", F.col("n").cast("long").alias("n"), F.round("mean", 4).alias("mean"), F.round("variance", 3).alias("variance"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey * 10 ELSE o_custkey END + CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END AS value FROM orders WHERE (o_orderkey < 100 OR o_orderkey >= 200) AND (o_orderkey % 7 <> 0 OR o_orderkey % 5 = 0) OR (o_orderkey % 5 = 0 AND o_orderkey >= 100 AND o_orderkey < 200)")
def overlay_view(spark, d):
    base = _orders_kv(spark, d)
    puts = base.where("key % 5 = 0").withColumn("value", F.col("value") * 10)
    adjusts = base.where("key % 2 = 0").select("key", F.lit(1).alias("delta")).unionByName(base.where("key % 2 = 0").select("key", F.lit(2).alias("delta")))
    return kv.overlay(base, base.where("key % 7 = 0"), puts, adjusts, kv.KeyRanges([kv.KeyRange(100, 200)]))


@query("SELECT DISTINCT r.tx, r.\"min\", r.\"max\", w.kind, w.key FROM (SELECT c_custkey AS tx, c_custkey * 10 AS \"min\", c_custkey * 10 + 5 AS \"max\" FROM customer) r JOIN (SELECT o_custkey AS tx, CASE o_orderstatus WHEN 'F' THEN 'put' WHEN 'O' THEN 'remove' ELSE 'adjust' END AS kind, o_orderkey AS key FROM orders) w ON r.tx <> w.tx AND w.key >= r.\"min\" AND w.key < r.\"max\"")
def conflict_detect(spark, d):
    reads = table(spark, d, "customer").select(F.col("c_custkey").alias("tx"), (F.col("c_custkey") * 10).alias("min"), (F.col("c_custkey") * 10 + 5).alias("max"))
    kind = F.when(F.col("o_orderstatus") == "F", "put").when(F.col("o_orderstatus") == "O", "remove").otherwise("adjust")
    return kv.conflicts(reads, table(spark, d, "orders").select(F.col("o_custkey").alias("tx"), kind.alias("kind"), F.col("o_orderkey").alias("key")))


@query("SELECT c_name AS watch, c_custkey AS key FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def key_watches(spark, d):
    watches = table(spark, d, "customer").select(F.col("c_name").alias("watch"), F.col("c_custkey").alias("key"))
    return kv.watched(table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("key")), watches)


# Consistency


def _stored(spark, d):
    view = simple_index(objects(spark, d), "Customer", "segment")
    rows = view.entries.where("_id % 9 <> 0")
    return view, rows.unionByName(rows.where("_id % 4 = 0").withColumn("value", F.lit("STALE")))


@query("SELECT c_mktsegment AS value, c_custkey AS id FROM customer WHERE c_custkey % 9 = 0")
def index_check_missing(spark, d):
    return consistency.missing_entries(*_stored(spark, d)).withColumnRenamed("_id", "id")


@query("SELECT 'STALE' AS value, c_custkey AS id FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 4 = 0")
def index_check_orphan(spark, d):
    return consistency.orphan_entries(*_stored(spark, d)).withColumnRenamed("_id", "id")


@query("SELECT c_mktsegment AS value, c_custkey AS id FROM customer")
def index_repair(spark, d):
    return consistency.repaired(*_stored(spark, d)).withColumnRenamed("_id", "id")


# Streams over the events as they arrive in files


def _arriving(spark, d):
    e = table(spark, d, "events")
    folder = shared_path(spark, "arriving")
    e.write.parquet(folder)
    return feed.changes_from(spark, folder, e.schema)


@query("SELECT event_type AS type, count(*) AS n, round(avg(value), 4) AS mean, round(CASE WHEN count(*) <= 1 THEN 0 ELSE var_pop(value) END, 3) AS variance FROM events GROUP BY 1")
def stream_maintained(spark, d):
    kept = feed.maintained(_arriving(spark, d).withColumnRenamed("event_type", "type"), ["type"], F.col("value"))
    return feed.to_table(kept.select("type", "n", F.round("mean", 4).alias("mean"), F.round("variance", 3).alias("variance")), shared_path(spark, "stream"), whole=True)


@query("SELECT event_id AS id, c_name AS watch FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING'")
def stream_watched(spark, d):
    watches = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("watch"), F.col("c_custkey").alias("user_id"))
    return feed.to_table(feed.watched(_arriving(spark, d), watches, "user_id").select(F.col("event_id").alias("id"), "watch"), shared_path(spark, "stream"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    w = feed.windowed(_arriving(spark, d).withColumnRenamed("event_type", "type").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "2 hours", ["type"])
    return feed.to_table(w.select(F.col("start").cast("timestamp_ntz").alias("start"), "type", "n"), shared_path(spark, "stream"), whole=True)
