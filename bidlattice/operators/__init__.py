"""Operators over the graph: every analytic is computed for all keys at once."""
