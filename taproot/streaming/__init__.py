"""Streams of delivered rows."""
