"""Jobs over the memory tables: writing, indexing, capturing."""
