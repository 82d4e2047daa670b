"""Readers that attach explicit row positions, and file inventories."""
