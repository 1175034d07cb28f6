"""Operators for preparing training text: extraction, deduplication, scanning, scoring, packing and binary output.

Nothing else in the library imports this subpackage.
"""
