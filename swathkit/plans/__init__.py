"""Query plans: searches, matchups, positions in start order."""
