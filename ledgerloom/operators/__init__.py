"""DataFrame-to-DataFrame building blocks: conform, filter, change, compare, check."""
