"""Operators over index, retrieval and dependency tables."""
