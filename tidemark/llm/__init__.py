"""Operators on training text and the records around it. Nothing outside this subpackage imports it."""
