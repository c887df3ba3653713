"""Part of palimpsest: sources."""
