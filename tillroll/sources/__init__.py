"""Readers and writers: driver tables, invoice CSV files, JSON-lines run logs."""
