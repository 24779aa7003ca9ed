"""Readers, ingest into node/edge frames, and table sinks."""
