"""Incremental synchronisation as a stream."""
