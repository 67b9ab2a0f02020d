"""Composed conversions, the survey layout, and the registered queries."""
