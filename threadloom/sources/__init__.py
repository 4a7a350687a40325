"""Sources of the conversation archive."""
