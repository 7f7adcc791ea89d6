"""Inventory-ledger analytics on Spark."""
