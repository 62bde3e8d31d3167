"""Named, ready-to-run queries over the given tables."""
