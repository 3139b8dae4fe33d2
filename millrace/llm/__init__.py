"""Operators over training-data corpora; see the README for contracts and limits."""
