"""Whole plans: the per-file analysis chain, and the fixtures on which the catalogue runs."""
