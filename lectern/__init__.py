"""Lectern: document analytics as Spark DataFrame operators."""
