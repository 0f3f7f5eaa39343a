"""Structured Streaming: scoring a comment stream, topic adjustment against a
published baseline table, windowed baselines."""
