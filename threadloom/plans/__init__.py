"""Plans of the conversation archive."""
