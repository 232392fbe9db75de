"""Joins, scans and aggregations over interval, frame and score tables."""
