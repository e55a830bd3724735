"""Structured Streaming over event logs. An extension: the batch engine does not need it."""

from .windows import counts_by_window, latest_by_key

__all__ = ["counts_by_window", "latest_by_key"]
