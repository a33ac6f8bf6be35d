"""Brindle: streaming."""
