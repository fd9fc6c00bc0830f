"""Readers of captured feeds, selections, settings and published books, for batch and stream alike."""
