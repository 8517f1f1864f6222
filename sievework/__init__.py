"""sievework: document screening and matching analytics on the Spark DataFrame API."""

__version__ = "0.1.0"
