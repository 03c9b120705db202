"""Ref-change events."""
