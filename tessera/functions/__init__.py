"""Functions of the cohort engine."""
