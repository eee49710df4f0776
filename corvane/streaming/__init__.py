"""Streaming forms of the store's operators."""

from corvane.streaming.feed import drop_repeats, due_batches, fold_feed, windowed_counts

__all__ = ["drop_repeats", "due_batches", "fold_feed", "windowed_counts"]
