"""Readers: memory tables, repository files, transcripts, skills."""
