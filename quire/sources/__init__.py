"""quire sources."""
