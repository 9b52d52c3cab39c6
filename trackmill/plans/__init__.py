"""Registered queries over the driver's tables."""
