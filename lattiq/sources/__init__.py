"""Readers and the canonical panels."""
