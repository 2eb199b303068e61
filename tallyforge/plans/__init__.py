"""plans of tallyforge."""
