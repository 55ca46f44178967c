"""Readers and writers: product lists, point files, dumps, catalogue files."""
