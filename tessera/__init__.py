"""Object-index query engine on PySpark: extents, ordered index views, paths, constraints and change feeds."""

__version__ = "0.1.0"
