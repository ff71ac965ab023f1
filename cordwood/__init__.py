"""Structured-log analytics as Spark jobs: ingest, listings, time buckets, reconciliation."""
