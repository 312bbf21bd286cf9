"""Operators over scored cases and slices."""
