"""Job-level helpers, the end-to-end workflow and the query catalogue."""
