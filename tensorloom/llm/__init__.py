"""Operators of a training-data pipeline: deduplication, decontamination, scoring, mixing, packing."""
