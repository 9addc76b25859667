"""Readers, writers, and the builder of input tables from a star schema."""
