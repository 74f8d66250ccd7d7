"""Log analytics on Spark: DataFrames in, DataFrames out."""

from lumenlog.session import get_spark

__all__ = ["get_spark"]
