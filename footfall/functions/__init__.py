"""Column-level building blocks: rule tables and scalar expressions."""
