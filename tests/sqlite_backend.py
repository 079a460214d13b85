"""A backend over a SQLite file, for the tests."""

from __future__ import annotations

import sqlite3


class Sqlite:
    def __init__(self, options):
        self.db = sqlite3.connect(options["path"])

    def splits(self, wanted):
        n = self.db.execute("SELECT count(*) FROM kv").fetchone()[0]
        step = max(1, n // wanted)
        return [r[0] for r in self.db.execute("SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM kv) WHERE i > 0 AND i % ? = 0 ORDER BY k", (step,))]

    def scan(self, low, high):
        where, args = [], []
        for text, value in (("k >= ?", low), ("k < ?", high)):
            if value is not None:
                where.append(text)
                args.append(value)
        yield from self.db.execute("SELECT k, v FROM kv" + (" WHERE " + " AND ".join(where) if where else "") + " ORDER BY k", args)
