"""Streaming of the conversation archive."""
