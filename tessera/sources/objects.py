"""Objects to and from files and databases."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.model import Model, Snapshot

#: Formats that hold whole types; XML with one element for each object.
FORMATS = ("parquet", "orc", "json", "xml", "avro")


def save(snapshot: Snapshot, path: str, format: str = "parquet", omit_defaults: bool = False) -> None:
    """Writes each type to a folder of its own. omit_defaults: values that equal the field's default become null, which
    read() puts back."""
    if format not in FORMATS:
        raise ValueError(f"no such format: {format}")
    for t, frame in snapshot.frames.items():
        if omit_defaults:
            for f in snapshot.model.types[t].fields:
                if f.default is not None:
                    frame = frame.withColumn(f.col, F.when(F.col(f.col) != F.lit(f.default), F.col(f.col)))
        writer = frame.write.format(format).mode("overwrite")
        if format == "xml":
            writer = writer.option("rowTag", t).option("rootTag", "objects")
        writer.save(f"{path}/{t}")


def load(spark: SparkSession, model: Model, path: str, schemas: Mapping[str, StructType], format: str = "parquet") -> Snapshot:
    """Reads what save() wrote. Schemas are stated, so nothing is read to infer them."""
    frames = {}
    for t in model.types:
        reader = spark.read.format(format).schema(schemas[t])
        frames[t] = (reader.option("rowTag", t) if format == "xml" else reader).load(f"{path}/{t}")
    return Snapshot(model, frames)


def save_elements(snapshot: Snapshot, path: str) -> None:
    """Writes all objects as XML of one form, whatever their types: an element for each object, with its type and id, that holds
    an element for each simple field that isn't null, with its name. Collections are left out; see save()."""
    parts = []
    for t, frame in snapshot.frames.items():
        fields = [f for f in snapshot.model.types[t].fields if f.kind not in ("set", "list", "map")]
        said = F.array(*[F.struct(F.lit(f.name).alias("_name"), F.col(f.col).cast("string").alias("_VALUE")) for f in fields]) if fields else F.array().cast("array<struct<_name:string,_VALUE:string>>")
        parts.append(frame.select(F.lit(t).alias("_type"), F.col("_id").cast("string").alias("_id"), F.filter(said, lambda x: x["_VALUE"].isNotNull()).alias("field")))
    reduce(DataFrame.unionByName, parts).write.format("xml").option("rowTag", "object").option("rootTag", "objects").mode("overwrite").save(path)


def load_elements(spark: SparkSession, model: Model, path: str, schemas: Mapping[str, StructType]) -> Snapshot:
    """Reads what save_elements() wrote, with the stated columns of each type."""
    raw = spark.read.format("xml").option("rowTag", "object").schema("_type string, _id string, field array<struct<_name:string,_VALUE:string>>").load(path)
    said = raw.select("_type", "_id", F.map_from_entries(F.coalesce("field", F.array().cast("array<struct<_name:string,_VALUE:string>>"))).alias("said"))
    frames = {}
    for t, schema in schemas.items():
        names = {f.col: f.name for f in model.types[t].fields}
        frames[t] = said.where(F.col("_type") == t).select(*[(F.col("_id") if c.name == "_id" else F.col("said")[names[c.name]]).cast(c.dataType).alias(c.name) for c in schema])
    return Snapshot(model, frames)


def export_plain(df: DataFrame) -> Iterator[dict[str, Any]]:
    """Objects as plain Python values, one partition at a time on the driver: collections as lists and dicts."""
    for row in df.toLocalIterator():
        yield row.asDict(recursive=True)


def assign_ids(rows: DataFrame, label: str, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with an _id for each distinct value of the column `label`, made from its hash, so that a rerun makes the same
    ones; and the map (label, _id). It is an error if two labels get one id, or if an id exists."""
    ids = rows.select(label).distinct().withColumn("_id", F.shiftrightunsigned(F.xxhash64(F.lit("id"), label), 1))
    clash = ids.groupBy("_id").count().where("count > 1")
    if not clash.isEmpty() or (existing is not None and not ids.join(existing.select("_id"), "_id", "left_semi").isEmpty()):
        raise ValueError("generated ids clash")
    return rows.drop("_id").join(ids, label), ids


def resolve(rows: DataFrame, field: str, ids: DataFrame, label: str) -> DataFrame:
    """Rows whose reference `field` holds labels, with ids in their place; unknown labels become null."""
    m = ids.select(F.col(label).alias("_label"), F.col("_id").alias("_to"))
    return rows.join(m, rows[field] == m["_label"], "left").withColumn(field, F.col("_to")).drop("_label", "_to")


def import_plain(spark: SparkSession, objects: Iterable[Mapping[str, Any]], schema: StructType | str) -> DataFrame:
    """Plain Python objects as rows."""
    return spark.createDataFrame([dict(o) for o in objects], schema)


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table of a SQL database, read in ranges of a numeric key at a time; filters and columns go to the database."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties=options)


def dump(df: DataFrame, elements: int = 20) -> DataFrame:
    """The same rows with arrays and maps cut to their first elements, for people to read."""
    first = lambda c: F.map_from_entries(F.slice(F.map_entries(c), 1, elements)).alias(c)
    return df.select(*[F.slice(c, 1, elements).alias(c) if t.startswith("array") else first(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes])
