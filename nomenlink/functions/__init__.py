"""Column-level building blocks: each takes Columns and returns a Column."""
