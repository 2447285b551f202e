"""Operators for large training corpora: one module per operator, ``plans`` registers their queries."""
