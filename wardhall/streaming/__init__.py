"""Sweeps as streams."""
