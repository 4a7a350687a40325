"""Functions of the conversation archive."""
