"""Part of palimpsest: functions."""
