"""Operator compositions: whole filters and whole analyses."""
