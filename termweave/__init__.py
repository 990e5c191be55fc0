"""Provenance-preserving keyword expansion over large text archives, on Spark."""
