"""Text analysis, geography and score-code functions as columns."""
