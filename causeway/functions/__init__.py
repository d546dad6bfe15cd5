"""Column expressions: hashes, indices, masks, tags and plane geometry."""
