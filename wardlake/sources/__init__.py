"""Readers and the tables derived from them."""
