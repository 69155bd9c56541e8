"""Column functions for text, and registration of the engine's functions for SQL."""
