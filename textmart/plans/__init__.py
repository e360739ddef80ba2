"""Operators wired together: the question mart and the registered query catalogue."""
