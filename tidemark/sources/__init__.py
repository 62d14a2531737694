"""Readers and writers: panels, tables, exclusions, constituents, manifests; and panels made of the given tables."""
