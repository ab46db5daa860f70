"""Incremental maintenance, in batches and as a stream."""
