"""Reading, harmonising and writing tables."""
