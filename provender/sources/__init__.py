"""Readers, writers and the canonical view over the driver tables."""
