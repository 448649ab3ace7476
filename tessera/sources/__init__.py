"""Sources of the cohort engine."""
