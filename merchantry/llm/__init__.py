"""Operators of a training-data pipeline: duplicates, quality, personal data, tokens, packing, chat."""
