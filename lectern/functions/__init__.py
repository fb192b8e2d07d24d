"""Column expressions: text, fixed-length arrays, seeded hashes, metric arithmetic."""
