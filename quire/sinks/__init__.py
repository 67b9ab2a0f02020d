from quire.sinks.writers import (CSV_WRITE_OPTIONS, write_csv, write_parquet, write_partitioned,
                                 write_text)

__all__ = ["CSV_WRITE_OPTIONS", "write_csv", "write_parquet", "write_partitioned", "write_text"]
