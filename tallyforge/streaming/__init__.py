"""streaming of tallyforge."""
