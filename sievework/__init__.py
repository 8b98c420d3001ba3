"""Data-engineering jobs on Spark: profile, check, reconcile, vault, map, ingest, synthesise, rank."""
