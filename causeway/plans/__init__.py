"""Bindings of driver tables to roles, and the queries over them."""
