"""Part of palimpsest: plans."""
