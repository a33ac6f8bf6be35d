"""Brindle: operators."""
