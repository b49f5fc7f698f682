"""Structured Streaming: micro-batch staging and windows over event time."""
