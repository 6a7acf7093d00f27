"""Operators over governed tables."""
