"""Bounded-memory access to examples."""
