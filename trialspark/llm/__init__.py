"""Operators for preparing training text: fingerprints, token counts, filters, archives, chat examples."""
