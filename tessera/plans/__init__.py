"""The driver's tables as objects, and the queries over them."""
