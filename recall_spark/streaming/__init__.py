"""Streams of transcript lines and memory events."""
