"""Generic relational, time-series and geometry operators."""
