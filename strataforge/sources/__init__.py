"""Readers and writers: file trees, change feeds, catalog tables, settings."""
