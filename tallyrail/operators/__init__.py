"""Batch operators over captured feeds: tape, latency, selection, routing, run health and order books."""
