"""Whole jobs built from the operators: profile, charts, governed SQL, history."""
