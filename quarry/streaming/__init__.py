"""Thin streaming wrappers over batch operators."""
