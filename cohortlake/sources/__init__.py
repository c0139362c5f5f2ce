"""Typed reading, writing and table versions."""
