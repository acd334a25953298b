"""Operators for preparing training data: filtering, deduplication, extraction, tokenising."""
