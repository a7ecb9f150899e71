"""Landed exports to resource tables."""
