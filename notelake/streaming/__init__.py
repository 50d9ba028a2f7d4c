"""Structured Streaming: event streams of models, rate windows, upserts."""
