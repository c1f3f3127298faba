"""Structured Streaming: incremental parsing and tumbling counts."""
