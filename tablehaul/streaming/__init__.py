"""Structured Streaming versions of the restore and of the run reports."""
