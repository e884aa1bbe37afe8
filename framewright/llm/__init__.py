"""Operators of a training-data pipeline: quality, dedup, decontamination, personal data, tokens, packing, archives, placement."""
