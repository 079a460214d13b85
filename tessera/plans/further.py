"""More queries by name, with their SQL: keys of objects, whole index views, events of collections, ranges, orders, stores."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tessera.functions.convert import key_after_prefix, list_insert, list_set, map_remove, next_key, ordered_bytes, set_add, set_remove
from tessera.functions.lineage import shared_path
from tessera.functions.ordering import register_order, sort_key
from tessera.operators import changes as ch
from tessera.operators import consistency, constraints, evolve, graph, kv, navigate, paths, sets
from tessera.operators.bounds import Bounds, Values, all_of, any_of
from tessera.operators.index import composite_index, in_versions, index_by_number, map_value_index, simple_index
from tessera.operators.model import Field, Model, ObjType, Snapshot, ref
from tessera.plans.catalog import query
from tessera.plans.tables import MODEL, ORDERS_WITH_PARTS, objects, orders_with_parts, table
from tessera.sources import entries
from tessera.sources import objects as store
from tessera.streaming import feed


def listed(values):
    """An array as text, so that all engines say it alike."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


_SORTED = "string_agg(CAST({0} AS VARCHAR), ',' ORDER BY {0})"

# Keys of objects, extents


@query("SELECT 'Customer' AS kind, c_custkey AS id, printf('%04x%016x', 1, c_custkey) AS key FROM customer UNION ALL SELECT 'Supplier', s_suppkey, printf('%04x%016x', 21, s_suppkey) FROM supplier")
def extent_key_ranges(spark, d):
    """The objects that are parties, told by ranges of keys among those of all types."""
    s = objects(spark, d)
    ranges = kv.KeyRanges([kv.KeyRange(a, b) for a, b in MODEL.key_ranges("Party")])
    found = s.by_key().where(ranges.predicate(F.col("key")))
    return found.select(F.col("_type").alias("kind"), F.col("_id").alias("id"), F.lower(F.hex("key")).alias("key"))


@query("SELECT CAST(7 AS BIGINT) AS id, 'unset' AS label, CAST(0 AS BIGINT) AS visits")
def singleton_created(spark, d):
    kind = ObjType("Setting", (Field("label", default="unset"), Field("visits", "counter")), singleton=True)
    empty = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("label"), F.col("c_custkey").alias("visits")).limit(0)
    s = Snapshot(Model([kind]), {"Setting": empty}).singleton_or_new("Setting", 7)
    return s.singleton_or_new("Setting", 8).singleton("Setting").select(F.col("_id").alias("id"), "label", "visits")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'NONE' END AS segment FROM customer")
def recreate_deleted(spark, d):
    """Customers that were deleted are created again, with defaults."""
    s = objects(spark, d, "Customer")
    kind = ObjType("Customer", (Field("segment", column="c_mktsegment", default="NONE"),))
    s = Snapshot(Model([kind]), {"Customer": s.of("Customer").select("_id", "c_mktsegment")})
    left = s.replaced(Customer=s.of("Customer").where("_id % 3 <> 0"))
    return left.created("Customer", s.of("Customer")).of("Customer").select(F.col("_id").alias("id"), F.col("c_mktsegment").alias("segment"))


@query("SELECT 'Region' AS kind, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'Nation', 0")
def cleared_snapshot(spark, d):
    s = objects(spark, d, "Region", "Nation").cleared()
    return s.of("Region").agg(F.lit("Region").alias("kind"), F.count("*").alias("n")).unionByName(s.of("Nation").agg(F.lit("Nation").alias("kind"), F.count("*").alias("n")))


# Whole index views


@query(f"SELECT c_mktsegment AS value, {_SORTED.format('c_custkey')} AS targets FROM customer GROUP BY 1")
def index1_map_of_sets(spark, d):
    return simple_index(objects(spark, d), "Customer", "segment").as_map().select("value", listed(F.col("targets")).alias("targets"))


@query("SELECT c_mktsegment AS value, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1")
def index1_map_in_pages(spark, d):
    pages = simple_index(objects(spark, d), "Customer", "segment").pages(50)
    return pages.groupBy("value").agg(F.sum(F.size("targets")).alias("n"), F.sum(F.aggregate("targets", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


@query(f"SELECT p_brand AS brand, p_size AS size, {_SORTED.format('p_partkey')} AS targets FROM part GROUP BY 1, 2")
def index2_map_of_sets(spark, d):
    return composite_index(objects(spark, d), "Part", "brandSize").as_map().select("brand", "size", listed(F.col("targets")).alias("targets"))


@query("SELECT p_brand AS brand, string_agg(p_size || ':' || p_partkey, ',' ORDER BY p_size, p_partkey) AS entries FROM part GROUP BY 1")
def index2_map_of_index1(spark, d):
    nested = composite_index(objects(spark, d), "Part", "brandSize").nested(1)
    return nested.select("brand", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["size"], e["_id"])), ",").alias("entries"))


@query("SELECT p_brand AS brand, p_type AS type, string_agg(p_size || ':' || p_partkey, ',' ORDER BY p_size, p_partkey) AS entries FROM part GROUP BY 1, 2")
def index3_map_of_index1(spark, d):
    nested = composite_index(objects(spark, d), "Part", "brandTypeSize").nested(2)
    return nested.select("brand", "type", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["size"], e["_id"])), ",").alias("entries"))


def _four(spark, d):
    kind = ObjType("Order", tuple(Field(n, column=c) for n, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"), ("customer", "o_custkey"), ("price", "o_totalprice"))), composites={"all": ("status", "priority", "customer", "price")})
    return composite_index(Snapshot(Model([kind]), {"Order": objects(spark, d, "Order").of("Order")}), "Order", "all")


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS customer, o_totalprice AS price, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_totalprice < 200000 AND o_custkey > 50")
def index4_composite(spark, d):
    v = _four(spark, d).within(Bounds.eq("F")).within(Bounds(100000.0, 200000.0), 4).within(Bounds.gt(50), 3)
    return v.as_set().withColumnRenamed("_id", "id")


@query("SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS customer FROM orders")
def index4_composite_prefix(spark, d):
    return _four(spark, d).as_index(3).as_index(2).as_set()


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(DISTINCT (o_custkey, o_totalprice, o_orderkey)) AS entries FROM orders GROUP BY 1, 2")
def index4_composite_map(spark, d):
    return _four(spark, d).as_map_of_index(2)


@query("SELECT p_brand AS brand, p_size AS size, p_partkey AS id FROM part WHERE p_size = 7")
def index_by_storage_id(spark, d):
    number = MODEL.storage_ids()["Part.brandSize"]
    return index_by_number(objects(spark, d), number).within(Bounds.eq(7), 2).as_set().withColumnRenamed("_id", "id")


@query("SELECT lower(c_mktsegment) AS value, c_custkey AS id FROM customer")
def index_converted(spark, d):
    v = simple_index(objects(spark, d), "Customer", "segment").mapped(value=F.lower("value"))
    return v.as_set().withColumnRenamed("_id", "id")


@query("SELECT c_mktsegment AS value, c_custkey AS id FROM customer WHERE c_custkey % 3 = 1")
def index_of_versions(spark, d):
    s = objects(spark, d)
    versions = s.of("Customer").select("_id", (F.col("_id") % 3).alias("_version"))
    return in_versions(simple_index(s, "Customer", "segment"), versions, 1, 5).as_set().withColumnRenamed("_id", "id")


# Predicates


@query("SELECT p_partkey AS id FROM part WHERE (p_size >= 5 AND p_size <= 20) OR p_size > 45")
def bounds_built(spark, d):
    b = Bounds(1, 99).with_lower(5).with_upper(20, True)
    open_ = Bounds.lt(45).reverse().with_lower(45, False).without_upper()
    return table(spark, d, "part").where(any_of(b.predicate(F.col("p_size")), open_.predicate(F.col("p_size")))).select(F.col("p_partkey").alias("id"))


@query("SELECT p_partkey AS id FROM part WHERE p_size BETWEEN 10 AND 19 AND p_brand = 'Brand#23'")
def filters_intersected(spark, d):
    empty = Bounds(5, 5)
    both = all_of(Bounds(10, 20).predicate(F.col("p_size")), Values(literals=("Brand#23",)).predicate(F.col("p_brand")))
    return table(spark, d, "part").where(any_of(both, empty.predicate(F.col("p_size"))) if empty.is_empty() else both).select(F.col("p_partkey").alias("id"))


# Keys and values


def _binary(spark, d):
    return table(spark, d, "orders").select(F.concat(F.col("o_orderpriority").cast("binary"), ordered_bytes(F.col("o_orderkey"))).alias("key"), F.col("o_orderkey").alias("value"))


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey = 99")
def kv_get(spark, d):
    return kv.get(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")), 99)


@query("SELECT o_orderkey AS value, CAST(8 AS INTEGER) AS bytes FROM orders WHERE o_orderpriority = '2-HIGH'")
def kv_prefix_view(spark, d):
    return kv.prefixed(_binary(spark, d), b"2-HIGH").select("value", F.octet_length("key").alias("bytes"))


@query("SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS place FROM orders")
def kv_key_order(spark, d):
    """Longs as bytes order as the longs do."""
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return navigate.numbered(keys, ordered_bytes(F.col("id")))


@query("SELECT o_orderkey AS value FROM orders WHERE o_orderkey > 40 AND o_orderkey <= 50")
def kv_next_keys(spark, d):
    """Ranges of binary keys from the key after one to the key after another."""
    low, high = next_key(ordered_bytes(F.lit(40).cast("long"))), next_key(ordered_bytes(F.lit(50).cast("long")))
    keys = table(spark, d, "orders").select(ordered_bytes(F.col("o_orderkey")).alias("key"), F.col("o_orderkey").alias("value"))
    assert key_after_prefix(b"a\xff") == b"b"
    return keys.where((F.col("key") >= low) & (F.col("key") < high)).select("value")


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0")
def kv_fallback_merged(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"))
    return kv.union_of_stores(o.where("key % 3 = 0"), o.where("key % 2 = 0").withColumn("value", F.lit(-1).cast("long")))


@query("SELECT DISTINCT r.c_custkey AS tx, greatest(r.c_custkey * 10, w.o_orderkey) AS \"from\", least(r.c_custkey * 10 + 5, w.o_orderkey + 3) AS \"to\" FROM customer r JOIN orders w ON r.c_custkey <> w.o_custkey AND w.o_orderkey < r.c_custkey * 10 + 5 AND w.o_orderkey + 3 > r.c_custkey * 10")
def conflict_removed_ranges(spark, d):
    reads = table(spark, d, "customer").select(F.col("c_custkey").alias("tx"), (F.col("c_custkey") * 10).alias("min"), (F.col("c_custkey") * 10 + 5).alias("max"))
    removes = table(spark, d, "orders").select(F.col("o_custkey").alias("tx"), F.col("o_orderkey").alias("from"), (F.col("o_orderkey") + 3).alias("to"))
    return kv.range_conflicts(reads, removes).select("tx", "from", "to").distinct()


@query("SELECT c_custkey AS tx, o_orderkey AS key FROM customer JOIN orders ON o_orderkey >= c_custkey * 10 AND o_orderkey < c_custkey * 10 + 5 AND o_custkey <> c_custkey")
def conflict_binary_keys(spark, d):
    key = lambda c: ordered_bytes(c.cast("long"))
    reads = table(spark, d, "customer").select(F.col("c_custkey").alias("tx"), key(F.col("c_custkey") * 10).alias("min"), key(F.col("c_custkey") * 10 + 5).alias("max"))
    writes = table(spark, d, "orders").select(F.col("o_custkey").alias("tx"), F.lit("put").alias("kind"), key(F.col("o_orderkey")).alias("key"))
    back = table(spark, d, "orders").select(key(F.col("o_orderkey")).alias("key"), F.col("o_orderkey").alias("back"))
    return kv.conflicts(reads, writes).join(back, "key").select("tx", F.col("back").alias("key"))


@query("SELECT c_name AS watch, o_orderkey AS key FROM customer JOIN orders ON o_orderkey >= c_custkey * 7 AND o_orderkey < c_custkey * 7 + 20 WHERE o_orderstatus = 'P'")
def key_range_watches(spark, d):
    watches = table(spark, d, "customer").select(F.col("c_name").alias("watch"), (F.col("c_custkey") * 7).alias("min"), (F.col("c_custkey") * 7 + 20).alias("max"))
    return kv.watched_ranges(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key")), watches)


@query("SELECT count(*) AS n FROM orders WHERE (o_orderkey >= 10 AND o_orderkey < 40) OR o_orderkey = 77")
def reads_tracked(spark, d):
    """What was read through a store, told again from the ranges that it remembers."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    t = kv.Tracked(o)
    t.get(77)
    t.scan(kv.KeyRange(10, 30))
    t.scan(kv.KeyRange(25, 40))
    return o.where(t.reads.predicate(F.col("key"))).agg(F.count("*").alias("n"))


@query("SELECT CAST(min(CAST(o_orderkey AS BIGINT)) AS BIGINT) AS low, CAST(max(o_orderkey) + 3 AS BIGINT) AS high FROM orders")
def key_ranges_all(spark, d):
    """Ranges without a group, merged, and what they span."""
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("min"), (F.col("o_orderkey") + 3).alias("max"))
    return kv.coalesced(r, per_cell=100).agg(F.min("min").alias("low"), F.max("max").alias("high"))


@query("WITH r AS (SELECT date_diff('minute', TIMESTAMP '1990-01-01', ts) AS lo FROM events), m AS (SELECT lo, CASE WHEN lo > max(lo + 40) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS isnew FROM r), i AS (SELECT lo, sum(isnew) OVER (ORDER BY lo ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT CAST(min(lo) AS BIGINT) AS \"min\", CAST(max(lo + 40) AS BIGINT) AS \"max\" FROM i GROUP BY island")
def key_ranges_coalesce_all(spark, d):
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 631152000000000) / 60000000).alias("min")
    r = table(spark, d, "events").select(minute).withColumn("max", F.col("min") + 40)
    return kv.coalesced(r, per_cell=50)


# Sets


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT 5")
def set_empty_and_singleton(spark, d):
    s = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return sets.union(s, sets.empty(s), sets.singleton(s, 5))


# Navigation


@query("SELECT e.event_id AS event, CAST(max(o.o_orderdate) AS DATE) AS floor_day FROM events e LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) <= CAST(e.ts AS DATE) GROUP BY 1")
def nav_asof_floor_dates(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("event"), F.col("ts").cast("date").alias("day"))
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return navigate.floors(e, o, "day", carry=["day"], cells=9).select("event", "floor_day")


@query("SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS place FROM customer")
def numbered_rows(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return navigate.numbered(c, F.col("c_acctbal"), F.col("id")).select("id", "place")


@query("(SELECT 'first' AS place, o_custkey AS key, o_orderkey AS entry FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1) UNION ALL (SELECT 'lower', o_custkey, o_orderkey FROM orders WHERE o_custkey < 40 ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1)")
def nav_map_entries(spark, d):
    """A table of entries, key to value, as an ordered map."""
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("entry"))
    low = navigate.last(m.where(Bounds.lt(40).predicate(F.col("key"))), "key", "entry")
    return navigate.first(m, "key", "entry").select(F.lit("first").alias("place"), "*").unionByName(low.select(F.lit("lower").alias("place"), "*"))


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey >= 50 AND o_orderkey < 400 ORDER BY 1 LIMIT 20")
def kv_range_limit(spark, d):
    return kv.scan(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")), kv.KeyRange(50, 400)).limit(20)


@query("SELECT * FROM (SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY 1 DESC LIMIT 100) ORDER BY id")
def pager_last(spark, d):
    return navigate.Pager(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), "id").last().page()


# Paths


@query("SELECT 'Customer' AS kind, c_custkey AS id FROM customer WHERE c_acctbal > 9000")
def path_empty(spark, d):
    s = objects(spark, d)
    p = paths.parse(MODEL, "Customer", "")
    assert p.is_singular() and p.targets == p.starts == ("Customer",)
    return paths.follow(s, p, s.of("Customer").where("c_acctbal > 9000").select("_id")).select(F.col("_type").alias("kind"), F.col("_id").alias("id"))


@query("SELECT DISTINCT 'Region' AS kind, n_regionkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def path_saved(spark, d):
    region_of = paths.saved(MODEL, "Customer", "->nation->region")
    s = objects(spark, d)
    return region_of(s, s.of("Customer").where("c_acctbal > 9000").select("_id")).select(F.col("_type").alias("kind"), F.col("_id").alias("id"))


@query("SELECT DISTINCT n_regionkey AS region, o_custkey AS customer FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 250000")
def path_pairs(spark, d):
    """Which customer each order leads to, and from there against the references."""
    s = objects(spark, d)
    p = paths.parse(MODEL, "Region", "<-Nation.region<-Customer.nation")
    buyers = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("_id")).distinct()
    return paths.follow_pairs(s, p, s.of("Region").select("_id")).join(buyers, "_id", "left_semi").select(F.col("_start").cast("int").alias("region"), F.col("_id").alias("customer"))


@query("SELECT DISTINCT 'Nation' AS kind, c_nationkey AS id FROM orders JOIN customer ON o_custkey = c_custkey")
def path_strict(spark, d):
    s = objects(spark, d)
    return paths.follow(s, paths.parse(MODEL, "Order", "->customer->nation"), s.of("Order").select("_id"), strict=True).select(F.col("_type").alias("kind"), F.col("_id").alias("id"))


# Deletion and references


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey <> 3")
def delete_forward(spark, d):
    """A deleted customer's nation goes too, and with it all who refer to that."""
    kinds = [replace(MODEL.types["Nation"], fields=tuple(f for f in MODEL.types["Nation"].fields if f.name != "region")), replace(MODEL.types["Customer"], fields=tuple(replace(f, forward_delete=True) if f.name == "nation" else f for f in MODEL.types["Customer"].fields))]
    s = objects(spark, d, "Nation", "Customer")
    s = Snapshot(Model(kinds), s.frames)
    start = navigate.first(s.of("Customer").where("c_nationkey = 3"), "_id").select(F.lit("Customer").alias("_type"), "_id")
    return graph.delete(s, start).checked().of("Customer").select(F.col("_id").alias("id"))


@query("SELECT c_custkey AS id, c_custkey // 2 AS parent FROM customer WHERE c_custkey // 2 IN (3, 6, 7) AND c_custkey > 3")
def delete_exception_order(spark, d):
    """Under EXCEPTION, a holder that goes as early, or later, still forbids; one's own reference doesn't."""
    kind = ObjType("Node", (ref("parent", "Node", on_delete="EXCEPTION"), ref("own", "Node", on_delete="EXCEPTION")))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.nullif(F.floor(F.col("c_custkey") / 2), F.lit(0)).alias("parent"), F.col("c_custkey").alias("own"))
    s = Snapshot(Model([kind]), {"Node": rows})
    start = s.of("Node").where("_id IN (3, 6, 7)").select(F.lit("Node").alias("_type"), "_id")
    return graph.delete(s, start).blockers.select(F.col("_id").alias("id"), F.col("to_id").alias("parent"))


def _apart(s):
    """Events with ids that no customer or supplier has."""
    return s.of("Event").withColumn("_id", F.col("_id") + 1000000)


@query("SELECT 'Event' AS kind, event_id + 1000000 AS id, user_id AS to_id, CASE WHEN user_id IN (SELECT s_suppkey FROM supplier) THEN 'type' ELSE 'deleted' END AS problem FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def reference_checks(spark, d):
    """References to customers: some are deleted, some ids are those of suppliers only."""
    s = objects(spark, d, "Region", "Nation", "Customer", "Supplier", "Event")
    s = s.replaced(Customer=s.of("Customer").where("_id % 3 <> 0"), Region=s.of("Region").limit(0), Nation=s.of("Nation").limit(0), Supplier=s.of("Supplier").withColumn("s_nationkey", F.lit(None).cast("int")), Event=_apart(s))
    s = s.replaced(Customer=s.of("Customer").withColumn("c_nationkey", F.lit(None).cast("int")))
    found = constraints.reference_violations(s)
    return found.select(F.col("_type").alias("kind"), F.col("_id").alias("id"), "to_id", "problem")


@query("SELECT count(*) AS n FROM events WHERE user_id % 3 = 0 AND user_id IN (SELECT s_suppkey FROM supplier UNION SELECT n_nationkey FROM nation UNION SELECT r_regionkey FROM region)")
def reference_allowed_deleted(spark, d):
    s = objects(spark, d, "Region", "Nation", "Customer", "Supplier", "Event")
    kinds = [replace(t, fields=tuple(replace(f, allow_deleted=True) for f in t.fields)) for t in s.model.types.values()]
    s = Snapshot(Model(kinds), s.frames.replaced({"Customer": s.of("Customer").where("_id % 3 <> 0"), "Event": _apart(s)}))
    return constraints.reference_violations(s).where("_type = 'Event' AND problem = 'type'").agg(F.count("*").alias("n"))


@query("SELECT step, count(*) AS n FROM (SELECT CAST(1 AS INTEGER) AS step FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 3 FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 4 FROM (SELECT least(count(*), 5) AS k FROM customer GROUP BY c_mktsegment HAVING count(*) > 1), unnest(range(k)) UNION ALL SELECT 5 FROM customer WHERE c_custkey > 100) GROUP BY 1")
def validate_order(spark, d):
    kind = ObjType("Customer", (Field("segment", column="c_mktsegment", indexed=frozenset({""}), unique=True), Field("balance", column="c_acctbal")))
    s = Snapshot(Model([kind]), {"Customer": objects(spark, d, "Customer").of("Customer")})
    rules = [constraints.Rule("Customer", "late", F.col("_id") <= 100), constraints.within("Customer", "c_acctbal", Values(ranges=(Bounds.le(5000.0),))), constraints.Rule("Customer", "early", F.col("c_acctbal") >= 0, early=True)]
    return constraints.validate(s, rules, steps=True).groupBy("step").agg(F.count("*").alias("n"))


# Schemas


@query("SELECT l_orderkey AS id, count(*) FILTER (WHERE l_partkey % 2 = 0) AS parts FROM lineitem GROUP BY 1")
def evolve_removed_elements(spark, d):
    s = orders_with_parts(spark, d)
    kinds = Model([ObjType("Even", ()), ObjType("Odd", ())])
    types = table(spark, d, "part").select(F.col("p_partkey").alias("_id"), F.when(F.col("p_partkey") % 2 == 0, "Even").otherwise("Odd").alias("_type"))
    out = evolve.without_removed_elements(s.of("Order"), ORDERS_WITH_PARTS.types["Order"].field("parts"), "element", kinds, types, ("Even",))
    return out.select(F.col("_id").alias("id"), F.size("parts").cast("long").alias("parts"))


@query("SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS stock, CAST(p_size AS VARCHAR) || '/' || p_brand AS said FROM part")
def evolve_on_change(spark, d):
    """A number becomes a counter; a function sees the old fields beside the new ones."""
    old = ObjType("Part", (Field("stock", column="p_size"), Field("brand", column="p_brand")))
    new = ObjType("Part", (Field("stock", "counter", column="stock"), Field("said")), version=2)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("_id"), "p_size", "p_brand")
    out = evolve.migrate(rows, old, new, {"stock": "REQUIRE"}, lambda df: df.withColumn("said", F.concat_ws("/", "_old.p_size", "_old.p_brand")), {"stock": "bigint"})
    return out.select(F.col("_id").alias("id"), "stock", "said")


@query("SELECT p_brand AS value, p_partkey AS id FROM part WHERE p_size >= 10 UNION ALL SELECT NULL, p_partkey FROM part WHERE p_size < 10")
def evolve_index_added(spark, d):
    """A field that is indexed from the second version on: objects of the first have their entries too."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("_id"), "p_size", F.col("p_brand").alias("brand"))
    kind = ObjType("Part", (Field("brand", indexed=frozenset({""})),), version=2)
    both = evolve.all_versions(p.where("p_size < 10").select("_id"), p.where("p_size >= 10").select("_id", "brand"))
    return simple_index(Snapshot(Model([kind]), {"Part": both}), "Part", "brand").as_set().withColumnRenamed("_id", "id")


@query("SELECT CAST(1 AS INTEGER) AS version, false AS used UNION ALL SELECT 2, true UNION ALL SELECT 3, true")
def schema_versions(spark, d):
    objects_ = table(spark, d, "customer").select((F.col("c_custkey") % 2 + 2).cast("int").alias("_version"))
    known = evolve.Schemas()
    for n in range(3):
        known, _ = known.added(Model([ObjType("Customer", tuple(Field(f"f{k}") for k in range(n + 1)))]))
    known, again = known.added(Model([ObjType("Customer", (Field("f0"),))]))
    assert again == 1 and sorted(known.collected(objects_).versions) == [2, 3] and sorted(known.removed(1, objects_).versions) == [2, 3]
    rows = [(v, v not in known.unused(objects_)) for v in known.versions]
    return spark.createDataFrame(rows, "version int, used boolean")


@query("SELECT '+ Part.weight' AS line UNION ALL SELECT '- Part.size' UNION ALL SELECT '~ Part.brand' UNION ALL SELECT '- type Region' UNION ALL SELECT '~ Part composite indexes'")
def schema_differences(spark, d):
    old = Model([MODEL.types["Region"], MODEL.types["Part"]])
    fields = (Field("brand", column="p_brand", indexed=frozenset({""}), default="x"), Field("type", column="p_type"), Field("weight"))
    new = Model.from_json(Model([ObjType("Part", fields, composites={"brandType": ("brand", "type")})]).to_json())
    return spark.createDataFrame([(x,) for x in old.differences(new)], "line string")


# Orders of values


@query("SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY c_custkey - 75 < 0, c_custkey - 75) AS BIGINT) AS place FROM customer")
def strict_order_unsigned(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return navigate.numbered(c, sort_key(F.col("id") - 75, "unsigned"))


@query("WITH u AS (SELECT c_custkey AS id, md5(c_name) AS h FROM customer) SELECT id, CAST(row_number() OVER (ORDER BY h[1:1] < '8', h[1:16], h[17:17] < '8', h[17:32]) AS BIGINT) AS place FROM u")
def strict_order_uuid(spark, d):
    h = F.md5("c_name")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return navigate.numbered(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), uuid.alias("u")), sort_key(F.col("u"), "uuid")).select("id", "place")


@query("SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'AUTOMOBILE' THEN 4 ELSE 0 END, c_custkey) AS BIGINT) AS place FROM customer")
def strict_order_enum(spark, d):
    key = sort_key(F.col("c_mktsegment"), "enum", names=["MACHINERY", "BUILDING", "HOUSEHOLD", "AUTOMOBILE"])
    return navigate.numbered(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), key, F.col("id")).select("id", "place")


@query("SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY c_custkey % 7, nullif(c_custkey % 5, 0) NULLS LAST, c_custkey) AS BIGINT) AS place FROM customer")
def strict_order_array(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_custkey") % 7, F.nullif(F.col("c_custkey") % 5, F.lit(0))).alias("a"))
    return navigate.numbered(rows, sort_key(F.col("a"), "array"), F.col("id")).select("id", "place")


@query("SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY c_custkey % 4 + 1, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 3 END, c_custkey) AS BIGINT) AS place FROM customer")
def strict_order_decimal(spark, d):
    """Equal numbers with fewer decimals come first."""
    text = F.concat((F.col("c_custkey") % 4 + 1).cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".0").otherwise(".000"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("n"))
    return navigate.numbered(rows, sort_key(F.col("n"), "decimal"), F.col("id")).select("id", "place")


@query("SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY length(c_name), c_name DESC) AS BIGINT) AS place FROM customer")
def strict_order_own(spark, d):
    """An order of one's own: longer names last, and the greater name first."""
    try:
        register_order("longest", lambda v: F.struct(F.length(v), F.translate(v, "0123456789", "9876543210")))
    except ValueError:
        pass  # it is there already
    return navigate.numbered(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), sort_key(F.col("c_name"), "longest")).select("id", "place")


@query("SELECT l_orderkey AS id, CAST(list_sum(l) AS BIGINT) AS total, CAST(len(l) AS BIGINT) AS n, m AS flags FROM (SELECT l_orderkey, [5] || list_distinct(coalesce(list(l_suppkey) FILTER (WHERE l_suppkey <> 3), [])) AS l, count(DISTINCT l_returnflag) FILTER (WHERE l_returnflag <> 'N') AS m FROM lineitem GROUP BY 1)")
def collection_ops_more(spark, d):
    """A set with an element added and one removed, put in front of by a list's insert and set; a map without a key."""
    flags = orders_with_parts(spark, d).of("Order").select("_id", "flags")
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(F.collect_set("l_suppkey").alias("s")).join(flags, "_id")
    made = list_set(list_insert(set_remove(set_add(F.col("s"), F.lit(3).cast("long")), F.lit(3).cast("long")), 0, F.lit(9).cast("long")), 0, F.lit(5).cast("long"))
    total = F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x)
    return o.withColumn("l", made).select(F.col("_id").alias("id"), total.alias("total"), F.size("l").cast("long").alias("n"), F.size(map_remove(F.col("flags"), F.lit("N"))).cast("long").alias("flags"))


# Events of collections, listeners


def _states(spark, d):
    """Orders with their lists of quantities and maps of flags, and a later state of them."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    k = F.col("_id") % 4
    changed = F.when(k == 0, F.concat("parts", F.array(F.lit(7).cast("long")))).when(k == 1, F.slice("parts", F.lit(1), F.size("parts") - 1)).when(k == 2, F.concat(F.array(F.lit(-1).cast("long")), F.slice("parts", F.lit(2), F.size("parts") - 1))).otherwise(F.slice("parts", 1, 0))
    return rows, rows.withColumn("parts", changed)


@query(
    "WITH l AS (SELECT l_orderkey AS id, count(*) AS n, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY 1) SELECT id, 'add' AS op, CAST(n AS INTEGER) AS \"at\", CAST(NULL AS BIGINT) AS old, CAST(7 AS BIGINT) AS \"new\" FROM l WHERE id % 4 = 0 UNION ALL SELECT id, CASE WHEN n = 1 THEN 'clear' ELSE 'remove' END, CASE WHEN n > 1 THEN CAST(n - 1 AS INTEGER) END, CASE WHEN n > 1 THEN hi END, NULL FROM l WHERE id % 4 = 1 UNION ALL SELECT id, 'replace', 0, lo, -1 FROM l WHERE id % 4 = 2 UNION ALL SELECT id, 'clear', NULL, NULL, NULL FROM l WHERE id % 4 = 3"
)
def change_list_events(spark, d):
    old, new = _states(spark, d)
    return ch.diff_lists(old, new, "parts").withColumnRenamed("_id", "id")


@query("SELECT l_orderkey AS id, CASE l_orderkey % 4 WHEN 0 THEN count(*) + 1 WHEN 1 THEN count(*) - 1 WHEN 2 THEN count(*) ELSE 0 END AS n, CAST(CASE l_orderkey % 4 WHEN 0 THEN sum(l_partkey) + 7 WHEN 1 THEN sum(l_partkey) - max(l_partkey) WHEN 2 THEN sum(l_partkey) - min(l_partkey) - 1 ELSE 0 END AS BIGINT) AS total FROM lineitem GROUP BY 1")
def change_list_replay(spark, d):
    old, new = _states(spark, d)
    steps = ch.diff_lists(old, new, "parts").withColumn("seq", F.when(F.col("op") == "remove", -F.col("at")).otherwise(F.col("at")))
    after = ch.replay_lists(old, steps, "parts")
    return after.select(F.col("_id").alias("id"), F.size("parts").cast("long").alias("n"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _flags(spark, d):
    """Orders with their maps of return flags, and a later state: F is gone, N says something else, Z is new; some are empty."""
    o = orders_with_parts(spark, d).of("Order").select("_id", "flags")
    later = F.map_concat(F.map_filter(F.transform_values("flags", lambda k, v: F.when(k == "N", F.lit("!")).otherwise(v)), lambda k, v: k != "R"), F.create_map(F.lit("Z"), F.lit("z")))
    return o, o.withColumn("flags", F.when(F.col("_id") % 5 == 0, F.map_filter("flags", lambda k, v: F.lit(False))).otherwise(later))


_FLAGS = "WITH f AS (SELECT l_orderkey AS id, l_returnflag AS key, max(l_linestatus) AS old FROM lineitem GROUP BY 1, 2)"


@query(f"{_FLAGS} SELECT id, 'remove' AS op, key, old, NULL AS \"new\" FROM f WHERE key = 'R' AND id % 5 <> 0 UNION ALL SELECT id, 'replace', key, old, '!' FROM f WHERE key = 'N' AND id % 5 <> 0 UNION ALL SELECT DISTINCT id, 'add', 'Z', NULL, 'z' FROM f WHERE id % 5 <> 0 UNION ALL SELECT DISTINCT id, 'clear', NULL, NULL, NULL FROM f WHERE id % 5 = 0")
def change_map_events(spark, d):
    old, new = _flags(spark, d)
    return ch.diff_maps(old, new, "flags").withColumnRenamed("_id", "id")


@query(f"{_FLAGS} SELECT id, key, CASE WHEN key = 'N' THEN '!' ELSE old END AS value FROM f WHERE key <> 'R' AND id % 5 <> 0 UNION ALL SELECT DISTINCT id, 'Z', 'z' FROM f WHERE id % 5 <> 0")
def change_map_replay(spark, d):
    old, new = _flags(spark, d)
    events = ch.diff_maps(old, new, "flags").select(F.lit(1).alias("seq"), "op", "_id", "key", F.col("new").alias("value"))
    base = old.select("_id", F.explode("flags").alias("key", "value"))
    return ch.replay_elements(base, events, ("_id", "key"), "value").withColumnRenamed("_id", "id")


@query("SELECT DISTINCT l_orderkey AS id, l_suppkey AS element FROM lineitem WHERE l_suppkey % 2 = 1 AND l_orderkey % 3 <> 0 UNION SELECT DISTINCT l_orderkey, -1 FROM lineitem")
def change_set_replay(spark, d):
    """Even elements are removed, all elements of every third object are cleared, then -1 is added."""
    base = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("_id"), F.col("l_suppkey").alias("element")).distinct()
    gone = base.where("element % 2 = 0").select(F.lit(1).alias("seq"), F.lit("remove").alias("op"), "_id", "element")
    clear = base.where("_id % 3 = 0").select(F.lit(2).alias("seq"), F.lit("clear").alias("op"), "_id", F.lit(None).cast("long").alias("element")).distinct()
    more = base.select(F.lit(3).alias("seq"), F.lit("add").alias("op"), "_id", F.lit(-1).cast("long").alias("element")).distinct()
    return ch.replay_elements(base, gone.unionByName(clear).unionByName(more)).withColumnRenamed("_id", "id")


@query("SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'remove suppliers' ELSE 'add suppliers' END AS op, l_orderkey AS id, l_suppkey AS element FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) WHERE l_suppkey % 5 <> 0")
def change_set_events(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("_id"), F.col("l_suppkey").alias("element")).distinct()
    return ch.diff_elements(s.where("element % 2 = 0 OR element % 5 = 0"), s.where("element % 2 = 1 OR element % 5 = 0"), "suppliers").withColumnRenamed("_id", "id")


@query("SELECT 'orders' AS listener, o_orderkey AS id, c_custkey AS changed, 'c_mktsegment' AS field, c_mktsegment AS old, 'NEW' AS \"new\" FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 5 = 0")
def notify_with_values(spark, d):
    """Orders are told which field of their customer changed, from what to what."""
    s = objects(spark, d)
    c = s.of("Customer").select("_id", "c_mktsegment")
    changes = ch.diff(c, c.withColumn("c_mktsegment", F.when(F.col("_id") % 5 == 0, "NEW").otherwise(F.col("c_mktsegment"))), ["c_mktsegment"]).select("_id", "field", "old", "new")
    return ch.told(s, {"orders": paths.parse(MODEL, "Order", "->customer")}, changes).select("listener", F.col("_id").alias("id"), "changed", "field", "old", "new")


@query("SELECT 'orders' AS listener, 'Order' AS kind, o_orderkey AS id FROM orders WHERE o_custkey % 10 = 0")
def notify_before_deletion(spark, d):
    s = objects(spark, d)
    found = ch.before_deletion(s, {"orders": paths.parse(MODEL, "Order", "->customer")}, s.of("Customer").where("_id % 10 = 0").select("_id"))
    return found.select("listener", F.col("_type").alias("kind"), F.col("_id").alias("id"))


@query("SELECT CAST(row_number() OVER (ORDER BY event_type, event_id) AS BIGINT) AS place, event_id AS id FROM events")
def change_delivery_order(spark, d):
    e = ch.in_order(table(spark, d, "events").select(F.col("event_id").alias("_id"), F.col("event_type").alias("field")), "field")
    return navigate.numbered(e, F.col("field"), F.col("_id")).select("place", F.col("_id").alias("id"))


@query("SELECT event_id AS id, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)".replace("ts, event_id", "ts"))
def neighbours_kept(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts")
    return ch.neighbours(e, ["user_id"], "ts").select("id", "before", "after")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'LATER' ELSE c_mktsegment END AS now, c_mktsegment AS pinned FROM customer")
def snapshot_detached(spark, d):
    """A snapshot stays as it is while a write gives a new one."""
    pinned = objects(spark, d, "Customer")
    later = pinned.upsert("Customer", pinned.of("Customer").where("_id % 2 = 0").withColumn("c_mktsegment", F.lit("LATER")))
    return later.of("Customer").select(F.col("_id").alias("id"), F.col("c_mktsegment").alias("now")).join(pinned.of("Customer").select(F.col("_id").alias("id"), F.col("c_mktsegment").alias("pinned")), "id")


@query("SELECT 'no c_name' AS problem, CAST(c_custkey AS BIGINT) AS id FROM customer WHERE c_custkey % 40 = 0 UNION ALL SELECT 'repeated id', 7")
def consistency_malformed(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.when(F.col("c_custkey") % 40 != 0, F.col("c_name")).alias("c_name"))
    return consistency.malformed(c.unionByName(c.where("_id = 7")), ["c_name"]).select("problem", F.col("_id").alias("id"))


# Stores: written in a form, and read again


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def store_xml_elements(spark, d):
    s = objects(spark, d, "Region", "Nation")
    path = shared_path(spark, "elements")
    store.save_elements(s, path)
    back = store.load_elements(spark, s.model, path, {"Nation": s.of("Nation").select("_id", "n_name", "n_regionkey").schema})
    return back.of("Nation").select(F.col("_id").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


def _stored(spark, d, form):
    s = objects(spark, d, "Customer")
    s = s.replaced(Customer=s.of("Customer").select("_id", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey"))
    path = shared_path(spark, f"store-{form}")
    store.save(s, path, form)
    return store.load(spark, s.model, path, {"Customer": s.of("Customer").schema}, form).of("Customer").select(F.col("_id").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


_CUSTOMERS = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer"


@query(_CUSTOMERS)
def store_parquet(spark, d):
    return _stored(spark, d, "parquet")


@query(_CUSTOMERS)
def store_orc(spark, d):
    return _stored(spark, d, "orc")


@query(_CUSTOMERS)
def store_json(spark, d):
    return _stored(spark, d, "json")


@query(_CUSTOMERS)
def store_xml_rows(spark, d):
    return _stored(spark, d, "xml")


@query("SELECT o_orderkey AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
def store_sorted_entries(spark, d):
    """Entries in sorted files; a range of keys reads those that can hold them."""
    path = shared_path(spark, "entries")
    keys = table(spark, d, "orders").select(ordered_bytes(F.col("o_orderkey")).alias("key"), F.col("o_orderkey").cast("string").cast("binary").alias("value"))
    entries.write_sorted(keys, path, 4)
    low, high = ((x ^ 1 << 63).to_bytes(8, "big") for x in (100, 300))
    return kv.scan(entries.read_sorted(spark, path), kv.KeyRange(low, high)).select(F.col("value").cast("string").cast("long").alias("value"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def store_xml_entries(spark, d):
    path = shared_path(spark, "entries-xml")
    keys = table(spark, d, "orders").select(ordered_bytes(F.col("o_orderkey")).alias("key"), F.col("o_orderkey").cast("string").cast("binary").alias("value"))
    entries.write_xml(keys, path)
    return entries.read_xml(spark, path).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("string").cast("long")).alias("total"))


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def store_plain_objects(spark, d):
    """Objects as plain Python values, and back."""
    rows = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return store.import_plain(spark, store.export_plain(rows), rows.schema)


@query("SELECT n_name AS label, (SELECT count(*) FROM nation) AS distinct_ids FROM nation")
def store_generated_ids(spark, d):
    rows, ids = store.assign_ids(table(spark, d, "nation").select(F.col("n_name").alias("label")), "label")
    return rows.join(store.resolve(rows.select(F.col("label").alias("own"), F.col("label")), "label", ids, "label").groupBy().agg(F.countDistinct("label").alias("distinct_ids")), how="cross").select("label", "distinct_ids")


@query("SELECT l_orderkey AS id, least(count(*), 2) AS shown FROM lineitem GROUP BY 1")
def dump_cut(spark, d):
    return store.dump(orders_with_parts(spark, d).of("Order").select("_id", "parts", "flags"), 2).select(F.col("_id").alias("id"), F.size("parts").cast("long").alias("shown"))


@query("SELECT l_orderkey AS id, l_returnflag AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2")
def map_value_index_all(spark, d):
    v = map_value_index(orders_with_parts(spark, d), "Order", "flags")
    return v.as_set(ordered=False).select(F.col("_id").alias("id"), F.col("key").alias("flag"), F.col("value").alias("status"))


# Streams


def _arriving(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = shared_path(spark, "arriving")
    e.write.parquet(folder)
    return feed.changes_from(spark, folder, e.schema)


@query("SELECT user_id AS \"user\", count(*) AS value FROM events GROUP BY 1")
def stream_counters(spark, d):
    c = feed.counters(_arriving(spark, d).withColumn("one", F.lit(1)).withColumnRenamed("user_id", "user"), ["user"], "one")
    return feed.to_table(c, shared_path(spark, "stream"), whole=True)


@query("SELECT event_id AS id, event_type AS type FROM events")
def stream_first_seen(spark, d):
    once = feed.first_seen(_arriving(spark, d), "event_id", "ts", "1 hour")
    return feed.to_table(once.select(F.col("event_id").alias("id"), F.col("event_type").alias("type")), shared_path(spark, "stream"))


@query("WITH e AS (SELECT user_id AS \"user\", ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT \"user\", ts, sum(fresh) OVER (PARTITION BY \"user\" ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT \"user\", min(ts) AS start, count(*) AS n FROM s GROUP BY \"user\", k")
def stream_sessions(spark, d):
    w = feed.sessions(_arriving(spark, d).withColumnRenamed("user_id", "user"), "ts", "12 hours", "2 days", ["user"])
    return feed.to_table(w.select("user", F.col("start").cast("timestamp_ntz").alias("start"), "n"), shared_path(spark, "stream"), whole=True)
