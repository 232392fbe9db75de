"""Readers and writers: file listings, annotation text, group maps, stores, reports."""
