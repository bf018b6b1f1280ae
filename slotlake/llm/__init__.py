"""Operators for training text and content chunks. Nothing outside this subpackage imports it."""
