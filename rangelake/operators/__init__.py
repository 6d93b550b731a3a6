"""Operators on records and manifests."""
