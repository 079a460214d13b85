"""Key/value backends of one's own as a Spark data source, read in ranges of keys."""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

NAME = "tessera_entries"


class Backend(Protocol):
    """What a backend offers. It is made on the driver and in each task, by a function of the options."""

    def splits(self, wanted: int) -> Sequence[bytes]:
        """Keys that cut the entries into about `wanted` parts, in order."""

    def scan(self, low: bytes | None, high: bytes | None) -> Iterator[tuple[bytes, bytes]]:
        """Entries from low on, below high, in the order of their keys; None: no end."""


def _made(options: dict[str, str]) -> Backend:
    module, _, name = options["backend"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


@dataclass
class Range(InputPartition):
    low: bytes | None
    high: bytes | None


class EntriesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.low, self.high = options, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the key narrow the ranges that are read; Spark applies what they don't settle."""
        for f in filters:
            key = getattr(f, "attribute", None) == ("key",)
            value = bytes(f.value) if key and isinstance(getattr(f, "value", None), (bytes, bytearray)) else None
            if value is None or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                low = value + b"\x00" if isinstance(f, GreaterThan) else value
                self.low = low if self.low is None else max(self.low, low)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high = value if isinstance(f, LessThan) else value + b"\x00"
                self.high = high if self.high is None else min(self.high, high)

    def partitions(self) -> Sequence[Range]:
        inner = [k for k in _made(self.options).splits(int(self.options.get("partitions", "8"))) if (self.low is None or k > self.low) and (self.high is None or k < self.high)]
        ends = [self.low, *inner, self.high]
        return [Range(a, b) for a, b in zip(ends, ends[1:], strict=False)]

    def read(self, partition: Range) -> Iterator[tuple[bytes, bytes]]:
        if partition.low is None or partition.high is None or partition.low < partition.high:
            yield from _made(self.options).scan(partition.low, partition.high)


class EntriesSource(DataSource):
    """Options: backend ("module:function"), partitions (parts to aim at), and what the backend asks for."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "key binary, value binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return EntriesReader(dict(self.options))


def read_backend(spark: SparkSession, backend: str, **options: str) -> DataFrame:
    """(key, value) of all entries of a backend; filters on the key are pushed down to its ranges."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EntriesSource)
    return spark.read.format(NAME).options(backend=backend, **options).load()
