"""Relational operators over evidence pixels, catalogs, road graphs and access results."""
