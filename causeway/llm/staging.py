"""Staged tables, as in the rest of the library."""

from causeway.staging import new_path, shared_dir, stage

__all__ = ["new_path", "shared_dir", "stage"]
