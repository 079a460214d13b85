"""What the operators of this subpackage share: picking columns, the shared folder, written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.lineage import shared_path

#: The characters that separate words, as a class for regular expressions.
SPACE = r"\x20\x09-\x0D"
#: A word.
WORD = rf"[^{SPACE}]+"


def let_workers_import(spark: SparkSession) -> None:
    """Puts the folder of this package on the path of Python workers started from now on. Where the workers have the
    package otherwise, as after spark-submit --py-files, this changes nothing."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), here]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder of Parquet tables `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as pick(df, new_name="old_name").

    Old names are matched exactly, so other columns whose names differ in case only, or that clash with names an
    operator uses itself, do no harm.
    """
    let_workers_import(df.sparkSession)
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[plain[f"_c{names.index(old)}"].alias(new) for new, old in columns.items()])


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that is no longer needed."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def settle(spark: SparkSession) -> None:
    """Collects the driver's garbage after a step of many shuffles: the heap that its tasks' events took goes back to the
    system, and Spark deletes the shuffle files and broadcasts that only finished steps held."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of text that a task works on at a time.
PIECE_BYTES = 4 << 20
#: A span of a text, as Arrow has it.
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("novelty", pa.float64())])
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<span>": pa.list_(SPAN)}
_SPARK = {"array<span>": "array<struct<kind:string,start:int,`end`:int,value_start:int,novelty:double>>"}


def give_back() -> None:
    """Returns to the system what memory a task no longer needs: its worker waits for tasks of other stages, which share
    the executor's memory with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_texts(docs: DataFrame, id_col: str, text_col: str, columns: dict[str, str], start: Callable[[], Callable[[list[str | None]], list[list]]]) -> DataFrame:
    """doc_id, and `columns` (name to type) that a function makes of a batch of whole texts, a list for each. `start` makes
    that function, once in each task. Ids of any type pass through as they are, nulls among them."""
    base = pick(docs, doc_id=id_col, text=text_col)
    kinds = [(n, _ARROW[k]) for n, k in columns.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in pieces(batches, 1):
            made = work(b.column(1).to_pylist())
            arrays = [b.column(0), *[pa.array(x, type=k) for x, (_, k) in zip(made, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])
        del work
        give_back()

    key = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, ", ".join([f"doc_id {key}", *[f"{n} {_SPARK.get(k, k)}" for n, k in columns.items()]]))


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the strings of a column have about PIECE_BYTES bytes in each, or one row has more: what is
    made of them stays small, however many rows Spark puts in a batch."""
    for b in batches:
        start = size = 0
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist() if pa.types.is_string(b.schema.field(column).type) else [PIECE_BYTES // 64] * b.num_rows
        for i, n in enumerate(lengths):
            if size and size + n > PIECE_BYTES:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < b.num_rows:
            yield b.slice(start)


def map_rows(docs: DataFrame, text_col: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """The same columns after a function of each Arrow batch. Names may clash, so columns go by place."""
    let_workers_import(docs.sparkSession)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at):
            yield work(b)
        give_back()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
