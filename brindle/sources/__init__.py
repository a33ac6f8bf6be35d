"""Brindle: sources."""
