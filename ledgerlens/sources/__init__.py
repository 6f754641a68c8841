"""Readers of landed pages and change feeds, and the adapter from order tables."""
