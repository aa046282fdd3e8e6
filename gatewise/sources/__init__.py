"""Readers and writers of cytometry files."""
