"""Stores, fields and filters."""
