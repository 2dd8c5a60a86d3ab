"""Operators on invoices, registries, purchase orders and saved state."""
