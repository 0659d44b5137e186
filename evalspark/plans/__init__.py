"""Whole plans: several operators joined into one result."""
