"""Readers, writers and moves between places."""
