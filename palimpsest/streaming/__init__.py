"""Part of palimpsest: streaming."""
