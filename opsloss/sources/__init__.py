"""Readers, adapters, dimension logs, batch ingest and table layout."""
