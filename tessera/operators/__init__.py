"""Operators of the cohort engine."""
