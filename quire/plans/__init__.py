"""quire plans."""
