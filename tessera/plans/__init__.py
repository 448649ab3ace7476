"""Plans of the cohort engine."""
