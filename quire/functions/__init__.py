"""quire functions."""
