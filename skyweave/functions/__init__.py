"""Expressions, units and numeric rules."""
