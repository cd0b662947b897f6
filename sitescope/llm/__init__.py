"""Operators for training-data pipelines: formatting, tokens, de-duplication, filters, scores."""
