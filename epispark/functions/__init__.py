"""Column -> Column building blocks; no actions, no Python UDFs."""
