"""Readers and writers of feeds, street exports and snapshots."""
