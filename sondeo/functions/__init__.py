"""Part of the survey-text library."""
