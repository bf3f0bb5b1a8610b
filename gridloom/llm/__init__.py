"""Operators for language-model training data: names, top items, canonical lists, leakage, mixing, residue."""
