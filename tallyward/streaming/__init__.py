"""Part of tallyward: streaming."""
