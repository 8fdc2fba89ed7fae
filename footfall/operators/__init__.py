"""Reusable DataFrame operators, each parametrised by the identity column."""
