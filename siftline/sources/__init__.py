"""Readers of raw evidence and writers of results."""
