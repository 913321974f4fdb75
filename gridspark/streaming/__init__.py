"""Selections that arrive as a stream."""
