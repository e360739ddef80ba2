"""Operators for preparing training texts. Nothing else in the library imports this subpackage."""
