"""Streaming jobs over the activity log."""
