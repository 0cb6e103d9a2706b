"""Reusable DataFrame-to-DataFrame composites the jobs are built from."""
