"""sluice: Spark-native ingestion of paged JSON API responses and push events.

Landed response pages, connector configs, watermarks and run logs are
DataFrames; every operator is a function ``DataFrame (+ args) -> DataFrame``
built from Spark SQL expressions, ``VARIANT`` functions, windows and
Structured Streaming.
"""
from sluice.session import get_session, configure  # noqa: F401

__version__ = "0.1.0"
