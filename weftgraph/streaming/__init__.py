"""Streams of document batches."""
