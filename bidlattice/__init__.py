"""Procurement intelligence and qualification analytics as PySpark operators."""
