"""Composite plans: embedding, relevance and their providers."""
