"""Relational operators beyond the DataFrame API: quantified comparison, upserts, constraints, full-text search."""
