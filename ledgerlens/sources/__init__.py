"""Readers: driver tables, input bindings, file listings, archives, feeds."""
