"""Ledger closing, grid smoothing and list operators as Spark jobs."""
