"""Relational and statistical operators of the engine."""
