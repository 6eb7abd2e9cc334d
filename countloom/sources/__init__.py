"""Readers of landed files and the games view."""
