"""Readers and writers for review tables and results."""
