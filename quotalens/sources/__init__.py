"""Typed tables from files."""
