"""Column builders: pure functions from Column to Column."""
