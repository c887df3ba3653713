"""Part of palimpsest: operators."""
