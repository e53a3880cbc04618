"""Helpers on query plans."""
