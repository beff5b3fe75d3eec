"""Data quality: checks, inferred rules, scorecards, profiles, score history."""
