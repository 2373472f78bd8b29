"""Sinks: tar shards with a committed state, result tables, and files."""
