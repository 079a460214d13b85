"""Change feeds: streams of changes, watched keys, counters and sums kept up to date, and state applied in batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def changes_from(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the change rows in the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def watched(changes: DataFrame, watches: DataFrame, by: str) -> DataFrame:
    """The changes of watched keys, with the watch: a join of the stream with a table."""
    return changes.join(watches, by)


def counters(changes: DataFrame, by: Sequence[str], delta: str) -> DataFrame:
    """Counters folded from the stream; their state is a row for each key."""
    return changes.groupBy(*by).agg(F.sum(delta).alias("value"))


def maintained(changes: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """(by, n, mean, variance) kept up to date; the variance is the population's, 0 for one row."""
    n = F.count(value)
    return changes.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(n <= 1, F.lit(0.0)).otherwise(F.var_pop(value)).alias("variance"))


def windowed(changes: DataFrame, at: str, window: str, late: str, by: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Changes counted by window of their time; those later than `late` are left out, and so state stays bounded."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return changes.withWatermark(at, late).groupBy(w.alias("window"), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(changes: DataFrame, at: str, gap: str, late: str, by: Sequence[str]) -> DataFrame:
    """Changes counted by session: a run of one key's changes with gaps shorter than `gap`."""
    return changes.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), *by).agg(F.count("*").alias("n")).select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *by, "n")


def first_seen(changes: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each change once, by its key; repeats within `late` are left out."""
    return changes.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def to_table(stream: DataFrame, path: str, whole: bool = False) -> DataFrame:
    """What a stream gives for all that has arrived, as a written table. whole: each batch gives the whole result anew,
    as sums over all changes do; otherwise batches add rows. A batch that is run again writes the same files anew."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if whole else f"{path}/rows/batch={number}")

    writer = stream.writeStream.outputMode("complete" if whole else "append").foreachBatch(put)
    writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{path}/rows")
    return found.select(*stream.columns)


def each_batch(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies a function to each batch of changes, as to replay them on a stored snapshot or to tell listeners; a batch
    that is run again has the same number."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
