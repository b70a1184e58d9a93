"""Readers and per-board normalisers for landed payloads."""
