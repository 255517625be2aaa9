"""Readers, writers, stage tables and file checks."""
