"""Stateless streaming forms of the per-row operators."""
