"""Streaming ingest of pending product lists."""
