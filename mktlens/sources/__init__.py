"""Reading, normalising and writing the engine's tables."""
