"""Ingest of new time steps."""
