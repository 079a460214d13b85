"""The tables as typed objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.model import Field, Frames, Model, ObjType, Snapshot, ref

_INDEXED = frozenset({""})
_ELEMENT = frozenset({"element"})


def _simple(name: str, column: str, **more) -> Field:
    return Field(name, column=column, indexed=_INDEXED, **more)


MODEL = Model(
    [
        ObjType("Region", (_simple("name", "r_name", unique=True),)),
        ObjType("Nation", (_simple("name", "n_name", unique=True), ref("region", "Region", column="n_regionkey", on_delete="DELETE", cascades=frozenset({"up"}), inverse_cascades=frozenset({"down"})))),
        ObjType("Customer", (_simple("segment", "c_mktsegment"), _simple("balance", "c_acctbal"), Field("name", column="c_name"), ref("nation", "Nation", column="c_nationkey", on_delete="DELETE", cascades=frozenset({"up"}), inverse_cascades=frozenset({"down"}))), interfaces=("Party",)),
        ObjType("Supplier", (_simple("balance", "s_acctbal"), Field("name", column="s_name"), ref("nation", "Nation", column="s_nationkey", on_delete="NULLIFY", cascades=frozenset({"up"}))), interfaces=("Party",)),
        ObjType("Part", (_simple("brand", "p_brand"), Field("type", column="p_type"), Field("size", column="p_size")), composites={"brandSize": ("brand", "size"), "brandTypeSize": ("brand", "type", "size")}),
        ObjType("Order", (_simple("date", "o_orderdate"), Field("status", column="o_orderstatus"), Field("priority", column="o_orderpriority"), ref("customer", "Customer", column="o_custkey", on_delete="EXCEPTION")), composites={"statusPriority": ("status", "priority")}),
        ObjType("Event", (_simple("type", "event_type"), Field("ts", column="ts"), Field("value", column="value"), ref("user", "Customer", column="user_id", on_delete="IGNORE"))),
    ]
)

_KEYS = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey"), "Event": ("events", "event_id")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str, *types: str) -> Snapshot:
    """A snapshot of the tables' objects, all types or the stated ones."""
    names = types or tuple(_KEYS)
    frames = Frames({t: lambda t=t: table(spark, sf_dir, _KEYS[t][0]).withColumn("_id", F.col(_KEYS[t][1])) for t in names})
    return Snapshot(Model([MODEL.types[t] for t in names]) if types else MODEL, frames)


ORDERS_WITH_PARTS = Model(
    [
        ObjType("Part", (_simple("brand", "p_brand"),)),
        ObjType("Order", (Field("parts", "list", column="parts", refs={"element": ("Part",)}, on_delete="REMOVE"), Field("flags", "map", column="flags", indexed=frozenset({"key", "value"})))),
    ]
)


def orders_with_parts(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Orders that hold their line items: a list of parts, in order, and a map from return flag to greatest line
    status."""
    items = table(spark, sf_dir, "lineitem")
    lists = items.groupBy(F.col("l_orderkey").alias("_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))), lambda x: x["l_partkey"]).alias("parts"))
    flags = items.groupBy(F.col("l_orderkey").alias("_id"), "l_returnflag").agg(F.max("l_linestatus").alias("status")).groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "status"))).alias("flags"))
    parts = table(spark, sf_dir, "part").withColumn("_id", F.col("p_partkey"))
    return Snapshot(ORDERS_WITH_PARTS, {"Order": lists.join(flags, "_id"), "Part": parts})
