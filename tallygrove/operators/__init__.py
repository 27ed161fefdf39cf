"""Operators over canonical tables: checks, rules, joins and findings."""
