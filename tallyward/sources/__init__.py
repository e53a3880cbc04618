"""Part of tallyward: sources."""
