"""Operators for preparing training text: sharding, language, near and exact duplicates, tokens, packing, archives."""
