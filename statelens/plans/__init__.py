"""Schemas of the engine's tables, and the registered queries."""
