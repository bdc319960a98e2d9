"""Whole exports and imports, put together from sources and operators."""
