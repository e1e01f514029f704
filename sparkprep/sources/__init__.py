"""Sources and sinks: CSV/Parquet readers, preview, writers, test tables."""
