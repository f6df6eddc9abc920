"""Aggregates over tables that grow file by file."""
