"""Operators for preparing training text: dedup, scans, filters, scoring, packing.

Nothing outside this subpackage imports it; ``entry.py`` here lists the queries
and their SQL.
"""
