"""Readers, catalog scans and sinks."""
