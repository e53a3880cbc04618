"""Part of tallyward: functions."""
