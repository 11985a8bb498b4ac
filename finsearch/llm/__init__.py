"""Operators for preparing training text: packing, fingerprints, archives, filters, formatting, encoding."""
