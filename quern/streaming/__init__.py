"""Extension: incremental counts."""
