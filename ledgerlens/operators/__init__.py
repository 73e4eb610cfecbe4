"""Table operators and distributed jobs."""
