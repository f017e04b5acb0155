"""Readers and writers of the artifacts."""
