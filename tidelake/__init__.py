"""tidelake: snapshot-based lakehouse tables, filters, deletes and statistics on PySpark."""

__version__ = "0.1.0"
