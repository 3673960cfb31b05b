"""Rows pulled one at a time from a result."""
