"""Readers, timelines of raw files, and writers."""
