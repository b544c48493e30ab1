"""Reusable transforms with contracts, and how they chain."""
