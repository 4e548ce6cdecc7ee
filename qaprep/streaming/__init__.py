"""Incremental runs of row-local jobs."""
