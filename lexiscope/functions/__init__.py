"""Part of lexiscope."""
