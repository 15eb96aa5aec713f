"""Column functions: characters, keyed draws, metrics, statistics."""
