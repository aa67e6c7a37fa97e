"""Reconciliation and change-delivery analytics on Spark."""
