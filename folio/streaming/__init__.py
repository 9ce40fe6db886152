"""Structured Streaming: answering a stream of request files."""
