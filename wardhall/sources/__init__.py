"""Specifications, stores, catalogs and artifacts."""
