"""Readers and writers of the star schema."""
