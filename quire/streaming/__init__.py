"""quire streaming."""
