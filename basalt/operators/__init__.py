"""Relational operators: one function each, names instead of positions, plans left to Catalyst."""
