"""Operators of the conversation archive."""
