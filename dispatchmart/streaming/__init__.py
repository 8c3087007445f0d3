"""Structured Streaming capture and scoring."""
