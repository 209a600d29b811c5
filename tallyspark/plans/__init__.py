"""Named queries over the benchmark tables, each with its SQL."""
