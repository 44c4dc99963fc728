"""Retail back-office analytics as Spark jobs: catalogue, orders, stock ledger, customers and audit trail."""
