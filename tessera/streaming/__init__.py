"""Structured Streaming layer over the same operators."""
