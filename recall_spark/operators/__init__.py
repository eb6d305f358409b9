"""Operators of the memory engine: listings, search, context, maintenance, chunking."""
