"""Compiled rules and views over input tables."""
