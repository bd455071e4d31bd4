"""Operators over long cohort tables."""
