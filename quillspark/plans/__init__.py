"""From statement text to typed, pruned requests."""
