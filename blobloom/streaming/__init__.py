"""Continuous model training with Structured Streaming."""
