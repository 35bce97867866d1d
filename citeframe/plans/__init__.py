"""Whole jobs: export of a papers table and the temporal cross-validation."""
