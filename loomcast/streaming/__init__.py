"""Streams: files that arrive over time are transformed batch by batch."""
