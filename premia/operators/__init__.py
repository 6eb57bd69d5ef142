"""Operators of the pricing pipeline."""
