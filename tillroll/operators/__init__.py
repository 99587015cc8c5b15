"""Operators over canonical invoice lines and run logs (DataFrame -> DataFrame)."""
