"""Document analytics on Spark: sources, retrieval, citation checks, quality gates and table maintenance."""

__version__ = "0.1.0"
