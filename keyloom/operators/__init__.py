"""Reads, writes, incremental and grouped reads, entities, text search and administration."""
