"""Column functions: expressions only, no jobs and no shuffles."""
