"""Operators for preparing training data: language ID, near duplicates, decontamination, mixing, sharding, search."""
