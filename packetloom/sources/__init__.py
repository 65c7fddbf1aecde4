"""Readers, writers and the capture-file decoder."""
