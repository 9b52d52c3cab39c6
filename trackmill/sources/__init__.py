"""Readers and writers for the file contracts."""
