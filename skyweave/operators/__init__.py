"""Verbs of datasets."""
