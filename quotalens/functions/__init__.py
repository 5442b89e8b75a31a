"""Analytical building blocks."""
