"""loomwork: a Spark-first analytics engine for semi-structured job-market data."""

__version__ = "0.1.0"
