"""A data source over a backend of one's own, against a plain dictionary."""

from __future__ import annotations

import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.sources.backend import EntriesReader, read_backend


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(6)
    data = {bytes(rng.randrange(256) for _ in range(rng.randrange(1, 4))): bytes([i % 256]) for i in range(300)}
    path = str(tmp_path_factory.mktemp("db") / "kv.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE kv (k BLOB PRIMARY KEY, v BLOB)")
    db.executemany("INSERT INTO kv VALUES (?, ?)", data.items())
    db.commit()
    here = os.path.dirname(os.path.abspath(__file__))
    env = spark.sparkContext.environment
    env["PYTHONPATH"] = os.pathsep.join([env.get("PYTHONPATH", ""), here, os.path.dirname(here)])
    return data, read_backend(spark, "sqlite_backend:Sqlite", path=path, partitions="5"), path


def plain(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def test_all_entries(stored):
    data, df, _ = stored
    assert plain(df) == data and df.rdd.getNumPartitions() >= 5


@pytest.mark.parametrize("where", ["key >= X'40'", "key > X'40' AND key <= X'9000'", "key < X'10' AND value > X'20'", "key = X'41'", "key > X'90' AND key < X'20'"])
def test_filters(stored, where):
    data, df, _ = stored
    rows = df.sparkSession.createDataFrame(list(data.items()), "key binary, value binary")
    assert plain(df.where(where)) == plain(rows.where(where))


def test_filters_narrow_the_ranges(stored):
    from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull, LessThan

    reader = EntriesReader({"backend": "sqlite_backend:Sqlite", "path": stored[2]})
    left = list(reader.pushFilters([IsNotNull(("key",)), GreaterThanOrEqual(("key",), b"\x40"), LessThan(("key",), b"\x50"), LessThan(("value",), b"\x50")]))
    assert len(left) == 2 and reader.partitions()[0].low == b"\x40" and reader.partitions()[-1].high == b"\x50"
    assert stored[1].where(F.lit(False)).count() == 0
