"""Readers and writers of the exchange formats."""
