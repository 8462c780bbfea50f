"""Bulk work on documents and the records taken from them, as Spark jobs."""
