"""Relational operators over role tables: filters, checks, joins, aggregates, order and allocation."""
