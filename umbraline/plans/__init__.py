"""Conditions as trees, and the plans that answer them."""
