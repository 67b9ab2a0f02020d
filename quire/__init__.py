"""quire: wide survey tables on Spark.

Read delimited and Parquet sources with null tokens, clean headers and
cells, re-encode as CSV or zstd Parquet, parse value-label codebooks, map
declared types to SQL and generate table definitions, and split very wide
tables into key-carrying sections. Every operator takes and returns
DataFrames built from Spark's own expressions.
"""

from quire import functions, operators, sinks, sources, streaming
from quire.session import checkpoint_dir, get_session, scratch_path

__all__ = ["functions", "operators", "sinks", "sources", "streaming",
           "checkpoint_dir", "get_session", "scratch_path"]
