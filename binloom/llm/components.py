"""Connected components, which both kinds of work need."""

from binloom.operators.components import components

__all__ = ["components"]
