"""Part of the caption engine."""
