"""quire operators."""
