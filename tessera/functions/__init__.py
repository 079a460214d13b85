"""Column functions: total orders of values, conversions between types, and operations on keys and collections."""
