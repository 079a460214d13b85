"""The query operators over typed objects, as lazy DataFrame operations."""
