from quire.streaming.ingest import incremental_ingest, ingest_log, read_ingested

__all__ = ["incremental_ingest", "ingest_log", "read_ingested"]
