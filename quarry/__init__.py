"""A retrieval and text-analytics engine whose operators are lazy Spark plans."""

__version__ = "0.1.0"
